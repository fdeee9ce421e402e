"""License scans: ordered signature rules over a text's words, as Spark expressions only.

A text is lower-cased (A-Z) and brought to words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, each between two spaces.
A rule is a hand-written regular expression over such words with a label, a priority, a confidence and a keyword
phrase; it runs only on texts that hold its keyword. Each match is an interval of words. An interval that lies
inside another one whose priority is as good or better is suppressed (equal intervals: better priority, then
smaller rule number). Base rules are never suppressed. There is no join and no shuffle: a row is scanned alone.

Defined cases: a null or empty text has no words and no detections; repeated rows and null ids are scanned
row by row; an empty table gives an empty result; extra columns stay, and a clash with a column made here
raises ValueError.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and labels that are always reported.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Signatures, written by hand: label, keyword, words. Among the words, ``a|b`` are alternatives, ``a?`` may be missing, and
#: ``*4`` stands for up to four words of any kind. A rule is tried on texts that hold its keyword.
#: Tags of machine-readable identifiers.
SPDX = (
    ("mit", "spdx", "spdx license identifier mit"),
    ("mit-0", "spdx", "spdx license identifier mit 0"),
    ("isc", "spdx", "spdx license identifier isc"),
    ("0bsd", "spdx", "spdx license identifier 0bsd"),
    ("bsd-2-clause", "spdx", "spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", "spdx", "spdx license identifier bsd 3 clause"),
    ("bsd-4-clause", "spdx", "spdx license identifier bsd 4 clause"),
    ("apache-2.0", "spdx", "spdx license identifier apache 2 0"),
    ("apache-1.1", "spdx", "spdx license identifier apache 1 1"),
    ("gpl-2.0-only", "spdx", "spdx license identifier gpl 2 0 only?"),
    ("gpl-2.0-or-later", "spdx", "spdx license identifier gpl 2 0 or later"),
    ("gpl-3.0-only", "spdx", "spdx license identifier gpl 3 0 only?"),
    ("gpl-3.0-or-later", "spdx", "spdx license identifier gpl 3 0 or later"),
    ("lgpl-2.1-only", "spdx", "spdx license identifier lgpl 2 1 only?"),
    ("lgpl-2.1-or-later", "spdx", "spdx license identifier lgpl 2 1 or later"),
    ("lgpl-3.0-only", "spdx", "spdx license identifier lgpl 3 0 only?"),
    ("lgpl-3.0-or-later", "spdx", "spdx license identifier lgpl 3 0 or later"),
    ("agpl-3.0-only", "spdx", "spdx license identifier agpl 3 0 only?"),
    ("agpl-3.0-or-later", "spdx", "spdx license identifier agpl 3 0 or later"),
    ("mpl-1.1", "spdx", "spdx license identifier mpl 1 1"),
    ("mpl-2.0", "spdx", "spdx license identifier mpl 2 0"),
    ("epl-1.0", "spdx", "spdx license identifier epl 1 0"),
    ("epl-2.0", "spdx", "spdx license identifier epl 2 0"),
    ("cddl-1.0", "spdx", "spdx license identifier cddl 1 0"),
    ("eupl-1.2", "spdx", "spdx license identifier eupl 1 2"),
    ("artistic-2.0", "spdx", "spdx license identifier artistic 2 0"),
    ("boost-1.0", "spdx", "spdx license identifier bsl 1 0"),
    ("zlib", "spdx", "spdx license identifier zlib"),
    ("unlicense", "spdx", "spdx license identifier unlicense"),
    ("wtfpl", "spdx", "spdx license identifier wtfpl"),
    ("ofl-1.1", "spdx", "spdx license identifier ofl 1 1"),
    ("python-2.0", "spdx", "spdx license identifier python|psf 2 0"),
    ("gfdl-1.3", "spdx", "spdx license identifier gfdl 1 3 only|or? later?"),
    ("cc0-1.0", "spdx", "spdx license identifier cc0 1 0"),
    ("cc-by-4.0", "spdx", "spdx license identifier cc by 4 0"),
    ("cc-by-3.0", "spdx", "spdx license identifier cc by 3 0"),
    ("cc-by-sa-4.0", "spdx", "spdx license identifier cc by sa 4 0"),
    ("cc-by-sa-3.0", "spdx", "spdx license identifier cc by sa 3 0"),
    ("cc-by-nc-4.0", "spdx", "spdx license identifier cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "spdx", "spdx license identifier cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "spdx", "spdx license identifier cc by nc nd 4 0"),
    ("cc-by-nd-4.0", "spdx", "spdx license identifier cc by nd 4 0"),
)
#: Sentences of the licences' own texts and standard notices.
TEXTS = (
    ("mit", "hereby  granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files? the? software? to deal in the software without restriction"),
    ("mit", "hereby  granted", "permission is hereby granted free of charge"),
    ("mit", "above  copyright", "the above copyright notice and this permission notice including? the? next? paragraph? shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("x11", "advertising", "except as contained in this notice the name|names of *8 shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("isc", "hereby  granted", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "hereby  granted", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "hereby  granted", "permission to use copy modify and distribute this software and its documentation for any purpose *4 is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials"),
    ("bsd-3-clause", "endorse", "neither the name|names of *12 nor the names of its|their|any contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", "the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("0bsd", "hereby  granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("apache-2.0", "apache", "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "distributed", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("gpl-1.0-or-later", "general  public", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0-only", "general  public", "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-2.0-or-later", "general  public", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "general  public", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3.0-only", "general  public", "under the terms of the gnu general public license as published by the free software foundation version 3 of the license"),
    ("gpl-2.0-only", "general  public", "under the terms of the gnu general public license as published by the free software foundation version 2 of the license"),
    ("gpl-1.0-or-later", "general  public", "you should have received a copy of the gnu general public license along with"),
    ("gpl-2.0", "share", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-1.0-or-later", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl-2.0-or-later", "library", "under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl-2.1", "lesser", "you should have received a copy of the gnu lesser general public license along with"),
    ("agpl-3.0-or-later", "affero", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0", "affero", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl-3.0", "affero", "you should have received a copy of the gnu affero general public license along with"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 1|2|3"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("epl-1.0", "eclipse", "made available under the terms of the eclipse public license v1|v 1? 0 which accompanies this distribution"),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public license 2 0 which is available at"),
    ("cddl-1.0", "development", "subject to the terms of the common development and distribution license"),
    ("cddl-1.0", "cddl", "the contents of this file are subject to the terms of the common development and distribution license *6 cddl"),
    ("boost-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("boost-1.0", "hereby  granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "implied  warranty", "this software is provided as is without any express or implied warranty in no event will|shall the author|authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "png", "the png reference library is supplied as is"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "want  to", "do what the fuck you want to public license"),
    ("artistic-1.0", "perl", "under the same terms as perl itself"),
    ("artistic-2.0", "artistic", "this is free software you can redistribute it and or modify it under the terms of the artistic license 2 0"),
    ("artistic-1.0", "perl", "this library|module|program is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "font", "reserved font name|names"),
    ("python-2.0", "python", "this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric  young", "this product includes cryptographic software written by eric young"),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("curl", "hereby  granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided"),
    ("ncsa", "ncsa", "developed under the university of illinois ncsa open source license"),
    ("postgresql", "written  agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", "portions of this software are copyright *6 the freetype project"),
    ("w3c", "w3c", "this work is being provided by the copyright holders under the following license *6 w3c"),
    ("unicode", "unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files and any associated documentation"),
    ("ms-pl", "accompanying", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("cc0-1.0", "waived", "to the extent possible under law *8 has|have waived all copyright and related or neighboring rights to"),
    ("cc-by-4.0", "creative  commons", "this work is licensed under a|the creative commons attribution 4 0 international license"),
    ("cc-by-3.0", "creative  commons", "this work is licensed under a|the creative commons attribution 3 0 unported|united? states? license"),
    ("cc-by-sa-4.0", "creative  commons", "this work is licensed under a|the creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa-3.0", "creative  commons", "this work is licensed under a|the creative commons attribution share? sharealike|alike 3 0 unported? license"),
    ("cc-by-nc-4.0", "creative  commons", "this work is licensed under a|the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-sa-4.0", "creative  commons", "this work is licensed under a|the creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd-4.0", "creative  commons", "this work is licensed under a|the creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nd-4.0", "creative  commons", "this work is licensed under a|the creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-sa", "contributions", "you must distribute your contributions under the same license as the original"),
    ("odbl-1.0", "database", "this *6 database is made available under the open database license"),
    ("public-domain", "public  domain", "this|the work|file|code|software|program is in the public domain"),
    ("public-domain", "public  domain", "released|placed|dedicated|put|donated in|into|to the public domain"),
    ("public-domain", "public  domain", "hereby|has been? placed|releases|dedicates *4 in|into|to the public domain"),
    ("public-domain", "public  domain", "public domain dedication"),
    ("proprietary", "confidential", "this software|document|file contains confidential and proprietary information of"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "prior  written", "may not be reproduced *8 without the prior written permission|consent of"),
)
#: Wordings that put something under a licence by its name.
NOTICES = (
    ("mit", "mit", "licensed|released|distributed|available|published|provided under the? terms? of? the? mit license|licence"),
    ("mit", "mit", "licensed|released|distributed under mit"),
    ("mit", "mit", "license|licence mit"),
    ("isc", "isc", "licensed|released|distributed|available under the? terms? of? the? isc license|licence"),
    ("bsd", "bsd", "licensed|released|distributed|available under the? terms? of? the|a bsd style? license|licence"),
    ("bsd-2-clause", "bsd", "licensed|released|distributed|available under the? terms? of? the? 2|two clause bsd license|licence"),
    ("bsd-3-clause", "bsd", "licensed|released|distributed|available under the? terms? of? the? 3|three clause bsd license|licence"),
    ("bsd-3-clause", "bsd", "licensed|released|distributed|available under the? terms? of? the? bsd 3 clause license|licence?"),
    ("bsd-2-clause", "bsd", "licensed|released|distributed|available under the? terms? of? the? bsd 2 clause license|licence?"),
    ("apache-2.0", "apache", "licensed|released|distributed|available|published|provided under the? terms? of? the? apache software? license|licence version|v? 2|v2 0?"),
    ("apache-2.0", "apache", "licensed|released|distributed under apache 2 0?"),
    ("apache-2.0", "apache", "license|licence apache 2 0?"),
    ("gpl-2.0", "general  public", "licensed|released|distributed|available|redistributed under the? terms? of? the? gnu? general public license|licence version|v? 2|v2 0?"),
    ("gpl-3.0", "general  public", "licensed|released|distributed|available|redistributed under the? terms? of? the? gnu? general public license|licence version|v? 3|v3 0?"),
    ("gpl-2.0", "gpl", "licensed|released|distributed|available under the? terms? of? the? gnu? gpl version|v? 2|v2 0?"),
    ("gpl-3.0", "gpl", "licensed|released|distributed|available under the? terms? of? the? gnu? gpl version|v? 3|v3 0?"),
    ("gpl", "general  public", "licensed|released|distributed|available|redistributed under the? terms? of? the? gnu general public license|licence"),
    ("gpl", "gpl", "licensed|released|distributed|available under the? terms? of? the? gnu? gpl"),
    ("lgpl", "lgpl", "licensed|released|distributed|available under the? terms? of? the? gnu? lgpl"),
    ("lgpl", "lesser", "licensed|released|distributed|available under the? terms? of? the? gnu? lesser general public license|licence"),
    ("agpl-3.0", "affero", "licensed|released|distributed|available under the? terms? of? the? gnu? affero general public license|licence"),
    ("agpl-3.0", "agpl", "licensed|released|distributed|available under the? terms? of? the? gnu? agpl"),
    ("mpl-2.0", "mozilla", "licensed|released|distributed|available|subject under|to the? terms? of? the? mozilla public license|licence version|v? 2 0"),
    ("mpl-2.0", "mpl", "licensed|released|distributed under the? mpl 2 0"),
    ("epl", "eclipse", "licensed|released|distributed|available under the? terms? of? the? eclipse public license|licence"),
    ("cddl-1.0", "cddl", "licensed|released|distributed|available under the? terms? of? the? cddl"),
    ("eupl", "eupl", "licensed under the eupl"),
    ("eupl", "union", "licensed under the european union public licence"),
    ("artistic", "artistic", "licensed|released|distributed|available under the? terms? of? the? artistic license|licence"),
    ("boost-1.0", "boost", "licensed|released|distributed|available under the? terms? of? the? boost software license|licence"),
    ("zlib", "zlib", "licensed|released|distributed|available under the? terms? of? the? zlib libpng? license|licence"),
    ("unlicense", "unlicense", "licensed|released|distributed|available under the? unlicense"),
    ("wtfpl", "wtfpl", "licensed|released|distributed under the? wtfpl"),
    ("ofl-1.1", "font", "licensed|released|distributed|available under the? terms? of? the? sil? open font license|licence"),
    ("gfdl", "documentation", "licensed|released|distributed|available under the? terms? of? the? gnu? free documentation license|licence"),
    ("cc0-1.0", "cc0", "licensed|released|dedicated|available under the? terms? of? the? cc0"),
    ("cc-by", "cc  by", "licensed|released|distributed|available|published under the? terms? of? the|a? cc by license|licence?"),
    ("cc-by-sa", "cc  by", "licensed|released|distributed|available|published under the? terms? of? the|a? cc by sa"),
    ("cc-by-nc", "cc  by", "licensed|released|distributed|available|published under the? terms? of? the|a? cc by nc"),
    ("cc-by", "creative  commons", "licensed|released|distributed|available|published under the? terms? of? the|a? creative commons attribution license|licence"),
    ("cc-by-sa", "creative  commons", "licensed|released|distributed|available|published under the? terms? of? the|a? creative commons attribution share? sharealike|alike license|licence"),
    ("odbl-1.0", "database", "licensed|released|available under the? terms? of? the? open database license|licence"),
    ("proprietary", "proprietary", "licensed under a|the proprietary license|licence"),
)
#: Names of licences alone.
NAMES = (
    ("mit", "mit", "mit license|licence"),
    ("mit", "expat", "expat license|licence"),
    ("isc", "isc", "isc license|licence"),
    ("bsd-2-clause", "bsd", "bsd 2 clause license|licence?"),
    ("bsd-2-clause", "bsd", "2|two clause bsd license|licence?"),
    ("bsd-2-clause", "bsd", "simplified bsd license|licence"),
    ("bsd-2-clause", "freebsd", "freebsd license|licence"),
    ("bsd-3-clause", "bsd", "bsd 3 clause license|licence?"),
    ("bsd-3-clause", "bsd", "3|three clause bsd license|licence?"),
    ("bsd-3-clause", "bsd", "new|revised|modified bsd license|licence"),
    ("bsd-4-clause", "bsd", "bsd 4 clause license|licence?"),
    ("bsd-4-clause", "bsd", "4|four clause|original bsd license|licence"),
    ("bsd", "bsd", "bsd style? license|licence"),
    ("0bsd", "0bsd", "0bsd"),
    ("apache-2.0", "apache", "apache software? license|licence version|v? 2|v2 0?"),
    ("apache-2.0", "apache", "apache 2 0 license|licence?"),
    ("apache-1.1", "apache", "apache software? license|licence version|v? 1 1"),
    ("apache", "apache", "apache license|licence"),
    ("gpl-2.0", "general  public", "gnu? general public license|licence version|v? 2|v2 0?"),
    ("gpl-3.0", "general  public", "gnu? general public license|licence version|v? 3|v3 0?"),
    ("gpl-2.0-or-later", "general  public", "gnu? general public license|licence version|v? 2|v2 0? or any? later"),
    ("gpl-3.0-or-later", "general  public", "gnu? general public license|licence version|v? 3|v3 0? or any? later"),
    ("gpl-2.0-only", "gpl", "gnu? gpl 2 0 only"),
    ("gpl-2.0-or-later", "gpl", "gnu? gpl version|v? 2|v2 0? or any? later"),
    ("gpl-3.0-only", "gpl", "gnu? gpl 3 0 only"),
    ("gpl-3.0-or-later", "gpl", "gnu? gpl version|v? 3|v3 0? or any? later"),
    ("gpl-2.0", "gpl", "gnu? gpl version|v? 2|v2 0?"),
    ("gpl-3.0", "gpl", "gnu? gpl version|v? 3|v3 0?"),
    ("gpl-2.0", "gplv2", "gplv2"),
    ("gpl-2.0-or-later", "gplv2", "gplv2 or later"),
    ("gpl-3.0", "gplv3", "gplv3"),
    ("gpl-3.0-or-later", "gplv3", "gplv3 or later"),
    ("gpl", "gpl", "gnu gpl"),
    ("lgpl-2.1", "lesser", "gnu? lesser general public license|licence version|v? 2 1"),
    ("lgpl-3.0", "lesser", "gnu? lesser general public license|licence version|v? 3 0?"),
    ("lgpl-2.0", "library", "gnu? library general public license|licence version|v? 2 0?"),
    ("lgpl", "lesser", "gnu? lesser general public license|licence"),
    ("lgpl-2.1-or-later", "lgpl", "lgpl version|v? 2 1 or any? later"),
    ("lgpl-2.1", "lgpl", "lgpl version|v? 2 1 only?"),
    ("lgpl-3.0-or-later", "lgpl", "lgpl version|v? 3 0? or any? later"),
    ("lgpl-3.0", "lgpl", "lgpl version|v? 3 0? only?"),
    ("lgpl-3.0", "lgplv3", "lgplv3"),
    ("agpl-3.0", "affero", "gnu? affero general public license|licence version|v? 3? 0?"),
    ("agpl-3.0-or-later", "agpl", "agpl version|v? 3 0? or any? later"),
    ("agpl-3.0", "agpl", "agpl version|v? 3 0? only?"),
    ("gfdl", "documentation", "gnu? free documentation license|licence version|v? 1? 1|2|3?"),
    ("mpl-2.0", "mozilla", "mozilla public license|licence version|v? 2 0"),
    ("mpl-1.1", "mozilla", "mozilla public license|licence version|v? 1 1"),
    ("mpl", "mozilla", "mozilla public license|licence"),
    ("mpl-2.0", "mpl", "mpl version|v? 2 0"),
    ("epl-2.0", "eclipse", "eclipse public license|licence version|v? 2|v2 0?"),
    ("epl-1.0", "eclipse", "eclipse public license|licence version|v? 1|v1 0?"),
    ("epl", "eclipse", "eclipse public license|licence"),
    ("cddl-1.0", "cddl", "cddl version|v? 1? 0?"),
    ("cddl-1.0", "development", "common development and distribution license|licence"),
    ("cpl-1.0", "common  public", "common public license|licence version|v? 1? 0?"),
    ("artistic-2.0", "artistic", "artistic license|licence version|v? 2 0?"),
    ("artistic-1.0", "artistic", "artistic license|licence"),
    ("boost-1.0", "boost", "boost software license|licence version|v? 1? 0?"),
    ("zlib", "zlib", "zlib libpng? license|licence"),
    ("unlicense", "unlicense", "the unlicense"),
    ("unlicense", "unlicense", "unlicense license|licence"),
    ("unlicense", "unlicense", "license|licence unlicense"),
    ("unlicense", "unlicense", "under unlicense"),
    ("mit", "mit  licensed", "mit licensed"),
    ("apache-2.0", "apache", "apache 2 0? licensed"),
    ("bsd", "bsd  licensed", "bsd licensed"),
    ("gpl", "gpl  licensed", "gpl licensed"),
    ("agpl-3.0", "agplv3", "agplv3"),
    ("agpl-3.0-or-later", "agplv3", "agplv3 or later"),
    ("lgpl-2.1", "lgplv2", "lgplv2 1"),
    ("lgpl-2.1-or-later", "lgplv2", "lgplv2 1 or later"),
    ("lgpl-2.0", "lgplv2", "lgplv2"),
    ("epl-2.0", "epl", "epl 2 0"),
    ("epl-1.0", "epl", "epl 1 0"),
    ("mit", "or  mit", "0|1|clause|later|only or mit"),
    ("mit", "mit  or", "mit or apache|bsd|gpl|lgpl|agpl|mpl|isc|zlib"),
    ("apache-2.0", "or  apache", "or apache 2 0"),
    ("gpl-2.0", "or  gpl", "or gpl 2 0 only?"),
    ("gpl-3.0", "or  gpl", "or gpl 3 0 only?"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("eupl-1.2", "eupl", "eupl version|v? 1 2"),
    ("eupl-1.1", "eupl", "eupl version|v? 1 1"),
    ("eupl", "union", "european union public licence|license"),
    ("ms-pl", "microsoft", "microsoft public license"),
    ("ms-rl", "microsoft", "microsoft reciprocal license"),
    ("ncsa", "ncsa", "ncsa open source license"),
    ("postgresql", "postgresql", "postgresql license|licence"),
    ("cc0-1.0", "cc0", "cc0 1? 0? universal?"),
    ("cc-by-4.0", "cc  by", "cc by version? 4 0"),
    ("cc-by-3.0", "cc  by", "cc by version? 3 0"),
    ("cc-by-sa", "cc  by", "cc by sa version? 2|3|4? 0|5?"),
    ("cc-by-nd", "cc  by", "cc by nd version? 2|3|4? 0|5?"),
    ("cc-by-nc", "cc  by", "cc by nc version? 2|3|4? 0|5?"),
    ("cc-by-nc-sa", "cc  by", "cc by nc sa version? 2|3|4? 0|5?"),
    ("cc-by-nc-nd", "cc  by", "cc by nc nd version? 2|3|4? 0|5?"),
    ("cc-by", "creative  commons", "creative commons attribution license|licence? 2|3|4? 0|5?"),
    ("cc-by-sa", "creative  commons", "creative commons attribution share? sharealike|alike license|licence? 2|3|4? 0|5?"),
    ("cc-by-nc", "creative  commons", "creative commons attribution non? noncommercial|commercial license|licence? 2|3|4? 0|5?"),
    ("cc-by-nd", "creative  commons", "creative commons attribution no? noderivatives|noderivs|derivatives license|licence? 2|3|4? 0|5?"),
    ("odbl-1.0", "database", "open database license|licence version|v? 1? 0?"),
    ("ofl-1.1", "font", "sil? open font license|licence version|v? 1? 1?"),
    ("python-2.0", "python", "python software foundation license|licence version|v? 2?"),
    ("openssl", "openssl", "openssl license|licence"),
)
#: Addresses of licence texts.
LINKS = (
    ("mit", "opensource", "opensource org licenses|license mit"),
    ("isc", "opensource", "opensource org licenses|license isc"),
    ("bsd-2-clause", "opensource", "opensource org licenses|license bsd 2 clause"),
    ("bsd-3-clause", "opensource", "opensource org licenses|license bsd 3 clause"),
    ("apache-2.0", "opensource", "opensource org licenses|license apache 2 0"),
    ("gpl-2.0", "opensource", "opensource org licenses|license gpl 2 0"),
    ("gpl-3.0", "opensource", "opensource org licenses|license gpl 3 0"),
    ("mpl-2.0", "opensource", "opensource org licenses|license mpl 2 0"),
    ("apache-2.0", "apache  org", "apache org licenses license 2 0"),
    ("apache", "apache  org", "apache org licenses"),
    ("gpl", "gnu  org", "gnu org licenses gpl"),
    ("gpl-2.0", "gnu  org", "gnu org licenses old? gpl 2 0"),
    ("gpl-3.0", "gnu  org", "gnu org licenses gpl 3 0"),
    ("lgpl", "gnu  org", "gnu org licenses lgpl"),
    ("agpl-3.0", "gnu  org", "gnu org licenses agpl 3 0"),
    ("mpl-2.0", "mozilla  org", "mozilla org mpl 2 0"),
    ("unlicense", "unlicense  org", "unlicense org"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero"),
    ("cc-by", "creativecommons", "creativecommons org licenses by"),
    ("cc-by-4.0", "creativecommons", "creativecommons org licenses by 4 0"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa 1|2|3|4? 0|5?"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc 1|2|3|4? 0|5?"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd 1|2|3|4? 0|5?"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa 1|2|3|4? 0|5?"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd 1|2|3|4? 0|5?"),
)
#: Sentences that deny a licence; what they name isn't granted, so their label stands for it.
DENIALS = (
    ("not-granted", "not  licensed", "not licensed under *6 license|licence"),
    ("not-granted", "not  licensed", "not licensed under the? gpl|lgpl|agpl|mit|bsd|apache|mpl version|v? 1|2|3|v2|v3? 0|1?"),
    ("not-granted", "not  released", "not released under *6 license|licence"),
    ("not-granted", "not  covered", "not covered by *6 license|licence"),
    ("not-granted", "not  under", "not under *6 license|licence"),
    ("not-granted", "is  granted", "no license|licence is granted"),
)
#: Lines that claim rights.
CLAIMS = (
    ("copyright", "c", "c (?:19|20)[0-9][0-9] [^ ]+"),
    ("no-warranty", "warranty", "provided as is without warranty of any kind"),
    ("no-warranty", "warranties", "provided as is without warranties"),
    ("copyright", "copyright", "copyright c? (?:19|20)[0-9][0-9]"),
    ("copyright", "copyrighted", "copyrighted material"),
    ("no-derivatives", "derivative", "no derivative works"),
    ("non-commercial", "commercial", "for non commercial use only"),
    ("non-commercial", "noncommercial", "for noncommercial use only"),
    ("evaluation", "evaluation", "for evaluation purpose|purposes only"),
)
#: Kinds of signatures: priority (1 is best) and confidence.
KINDS = ((DENIALS, 1, 0.9), (SPDX, 1, 1.0), (TEXTS, 2, 0.98), (LINKS, 3, 0.9), (NOTICES, 3, 0.9), (NAMES, 4, 0.7), (CLAIMS, 5, 0.4))


@dataclass(frozen=True)
class Rule:
    """A signature: regular expression over words that each stand between two spaces."""

    number: int
    label: str
    priority: int
    confidence: float
    keyword: str
    regex: str
    base: bool


def words_regex(text: str) -> str:
    """``a b|c d? *2`` as an expression over ' a ', ' b ' or ' c ', perhaps ' d ', and up to two words more."""
    out = []
    for word in text.split():
        if word.startswith("*"):
            out.append(f"(?: [^ ]+ ){{0,{word[1:]}}}")
            continue
        options = word.removesuffix("?")
        one = f" (?:{options}) " if "|" in options else f" {options} "
        out.append(f"(?:{one})?" if options != word else one)
    return "".join(out)


def signature_rules() -> list[Rule]:
    """The base rules, then the signatures of every kind."""
    rules = [Rule(k, label, 0, 0.9, f" {phrase.replace(' ', '  ')} ", words_regex(phrase), True) for k, (phrase, label) in enumerate(BASE)]
    for signatures, priority, confidence in KINDS:
        for label, keyword, words in signatures:
            rules.append(Rule(len(rules), label, priority, confidence, f" {keyword} ", words_regex(words), False))
    return rules


def spaced_words(text: Column) -> Column:
    """The words of a text, in order, each between two spaces of its own; '' without words.

    The Kelvin sign is replaced first, as it is the one letter whose lower case is an ASCII letter.
    """
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    inner = F.btrim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "))
    return F.when(inner == "", "").otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def n_words(spaced: Column) -> Column:
    """Words in a stretch of spaced words: two spaces each."""
    return ((F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


KEPT = "array<struct<rule:int,label:string,start:bigint,end:bigint,priority:int,confidence:double,base:boolean>>"
HITS = "array<struct<rule:int,parts:array<string>>>"
OPEN, CLOSE = "\x01", "\x02"  #: around a match; spaced words hold neither
GROUP = 256  #: steps of an array that is grown by one


def rules_literal(rules: list[Rule]) -> Column:
    """What a detection takes from its rule, as one constant array; a rule's number is its place."""
    kind = "array<struct<number:int,label:string,priority:int,confidence:double,base:boolean>>"
    return F.from_json(F.lit(json.dumps([{k: v for k, v in asdict(r).items() if k not in ("keyword", "regex")} for r in rules])), kind)


def hits_of(spaced: str, rules: list[Rule]) -> Column:
    """For each rule that matches: its number, and the parts of the text: what stands before the first match, then each match with what follows.

    Expressions are constants, so that each is compiled once; those of one keyword run only on texts that hold it.
    """
    groups: dict[str, list[Rule]] = {}
    for r in rules:
        groups.setdefault(r.keyword, []).append(r)

    def text(x: str) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def one(r: Rule) -> str:
        return f"named_struct('rule', {r.number}, 'parts', split(regexp_replace({spaced}, {text(r.regex)}, {text(f'{OPEN}$0{CLOSE}')}), {text(OPEN)}, -1))"

    # one text that Spark parses: some thousand expressions one by one take seconds to build
    tried = [f"CASE WHEN contains({spaced}, {text(k)}) THEN array({', '.join(map(one, some))}) ELSE cast(array() AS {HITS}) END" for k, some in groups.items()]
    return F.expr(f"filter(flatten(array({', '.join(tried)})), h -> size(h.parts) > 1)")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, join: Callable[[Column, Column], Column], start: int) -> Column:
    """For each number of an array all those before it, joined (a sum, a maximum); in groups, so that no long array is grown by one."""

    def running(some: Column, first: Column) -> Column:
        state = F.struct(first.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(some, state, lambda acc, x: F.struct(join(acc["at"], x).cast("long").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def grouped(v: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / GROUP).cast("int")), lambda g: F.slice(v, g * GROUP + 1, F.lit(GROUP)))
        return let(groups, lambda gs: F.flatten(F.zip_with(gs, running(F.transform(gs, lambda g: F.aggregate(g, F.lit(start).cast("long"), lambda s, x: join(s, x).cast("long"))), F.lit(start)), running)))

    return let(values, grouped)


def intervals(hit: Column, rules: Column) -> Column:
    """The intervals of words that a rule matches; end is after the last word."""

    def placed(sizes: Column) -> Column:
        at = before(F.transform(sizes, lambda s: s["hit"] + s["rest"]), lambda a, b: a + b, 0)
        return F.zip_with(sizes, at, lambda s, n: F.struct((n + s["lead"]).alias("start"), (-(n + s["lead"] + s["hit"])).alias("back"), s["r"]["priority"].alias("priority"), s["r"]["number"].alias("rule"), s["r"]["label"].alias("label"), s["r"]["confidence"].alias("confidence"), s["r"]["base"].alias("base")))

    lead, rule = n_words(F.get(hit["parts"], F.lit(0))), F.get(rules, hit["rule"])
    parts = F.slice(hit["parts"], F.lit(2), F.size(hit["parts"]) - 1)
    sizes = F.transform(parts, lambda p: F.struct(n_words(F.substring_index(p, CLOSE, 1)).alias("hit"), n_words(F.substring_index(p, CLOSE, -1)).alias("rest"), lead.alias("lead"), rule.alias("r")))
    return let(sizes, placed)


def unsuppressed(found: Column, levels: int) -> Column:
    """Detections (start, back: minus the end, priority and others) that stay: base ones, and those not inside another of a priority as good.

    In the order of starts, longer ones first, a detection is inside another if one before it ends as late; for each priority
    the latest end before each detection is kept as an array.
    """

    def kept(ordered: Column) -> Column:
        def reach(level: int) -> Column:
            ends = F.transform(ordered, lambda d: F.when((d["priority"] <= level) & ~d["base"], -d["back"]).otherwise(F.lit(-1).cast("long")))
            return before(ends, lambda a, b: F.greatest(a, b), -1)

        def stays(reaches: Column) -> Column:
            return F.filter(ordered, lambda d, k: d["base"] | (F.get(F.get(reaches, d["priority"]), k) < -d["back"]))

        return let(F.array(*map(reach, range(levels))), stays)

    stay = let(F.array_sort(found), kept)
    return F.transform(stay, lambda d: F.struct(d["rule"].alias("rule"), d["label"].alias("label"), d["start"].alias("start"), (-d["back"]).alias("end"), d["priority"].alias("priority"), d["confidence"].alias("confidence"), d["base"].alias("base")))


def scan_licenses(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """docs with ``license_words`` (words of the text) and ``licenses``: the detections that stay, in order of start.

    A detection is struct<rule, label, start, end, priority, confidence, base>, with start and end in words.
    """
    rules = signature_rules() if rules is None else rules
    made = ["license_words", "licenses", "_spaced", "_hits"]
    if clash := [c for c in docs.columns if c.lower() in made]:
        raise ValueError(f"columns of the input clash with those made here: {clash}")
    by_letter: dict[str, list[str]] = {}
    for k in sorted({r.keyword for r in rules}):
        by_letter.setdefault(k[1], []).append(re.escape(k[2:]))
    some = F.rlike(F.col("_spaced"), F.lit(" (?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items()) + ")"))
    constants = rules_literal(rules)
    found = F.flatten(F.transform("_hits", lambda h: intervals(h, constants)))
    levels = max(r.priority for r in rules) + 1
    return (
        docs.withColumn("_spaced", spaced_words(F.col(text)))
        .withColumn("_hits", F.when(some, hits_of("_spaced", rules)).otherwise(F.array().cast(HITS)))
        .withColumn("license_words", n_words(F.col("_spaced")))
        .withColumn("licenses", F.when(F.size("_hits") > 0, unsuppressed(found, levels)).otherwise(F.array().cast(KEPT)))
        .drop("_spaced", "_hits")
    )


def license_digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: counts, places and labels of base and all detections."""
    base = F.filter("licenses", lambda d: d["base"])

    def joined(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")

    return scan_licenses(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("license_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("licenses")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
