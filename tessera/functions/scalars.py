"""Scalar functions of a media catalog, as column expressions. Null arguments give null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types by file extension, and the shorter table that uploads use.
TYPE_BY_EXTENSION = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic", "heif": "image/heif", "avif": "image/avif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
UPLOAD_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic", "heif": "image/heif", "avif": "image/avif", "tiff": "image/tiff"}

#: What the orientation tag says.
ORIENTATIONS = {1: "Normal", 2: "Mirrored", 3: "Rotated 180°", 4: "Mirrored, 180°", 5: "Mirrored, 90° CCW", 6: "Rotated 90° CW", 7: "Mirrored, 90° CW", 8: "Rotated 90° CCW"}

#: White space of any kind: ASCII, no-break spaces, the Unicode space separators, line and paragraph ends, the byte order mark.
WHITE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{WHITE}|{WHITE}$", "")


def half_up(x: Column) -> Column:
    """The nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def exif_date(text: Column) -> Column:
    """'YYYY:MM:DD HH:MM:SS' as 'YYYY-MM-DDTHH:MM:SS'; anything else is null."""
    fits = text.rlike(r"\A\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}\z")
    return F.when(fits, F.concat(F.translate(F.substring(text, 1, 10), ":", "-"), F.lit("T"), F.substring(text, 12, 8)))


def number_text(x: Column) -> Column:
    """A number without a fraction of zero."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def exposure_text(seconds: Column) -> Column:
    """Seconds from 1 on as they are, shorter ones as a fraction; null unless positive."""
    return F.when(seconds >= 1, F.concat(number_text(seconds), F.lit("s"))).when(seconds > 0, F.concat(F.lit("1/"), half_up(1 / seconds).cast("string"), F.lit("s")))


def extension(name: Column) -> Column:
    """The lower-cased extension of the last part of a path; null for none, for dot files and for a dot at the end."""
    base = F.substring_index(name, "/", -1)
    found = F.substring_index(base, ".", -1)
    return F.when((F.length(base) - F.length(found) > 1) & (found != ""), F.lower(found))


def _looked_up(key: Column, known: dict) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.try_element_at(pairs, key)


def type_from_filename(name: Column) -> Column:
    """The type by extension, image/jpeg for unknown ones and for null."""
    return F.coalesce(_looked_up(F.coalesce(extension(name), F.lit("")), TYPE_BY_EXTENSION), F.lit("image/jpeg"))


def upload_type(name: Column, given: Column) -> Column:
    """The type of an upload: by extension, else the given one if not empty, else octet-stream."""
    by_name = _looked_up(F.coalesce(F.lower(F.substring_index(name, ".", -1)), F.lit("")), UPLOAD_TYPES)
    return F.coalesce(by_name, F.nullif(given, F.lit("")), F.lit("application/octet-stream"))


def tenths(x: Column) -> Column:
    """One digit after the point, halves of the decimal value up."""
    return F.round(x.cast("decimal(30,12)"), 1).cast("decimal(30,1)").cast("string")


def bytes_text(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(tenths(n / 1024), F.lit(" KB"))).otherwise(F.concat(tenths(n / (1024 * 1024)), F.lit(" MB")))


def megapixels_text(width: Column, height: Column) -> Column:
    """Null unless both are positive."""
    return F.when((width > 0) & (height > 0), F.concat(tenths(width.cast("double") * height / 1_000_000), F.lit(" MP")))


def orientation_text(tag: Column) -> Column:
    return F.coalesce(_looked_up(tag, ORIENTATIONS), F.concat(F.lit("Unknown ("), tag.cast("string"), F.lit(")")))


def content_key(kind: Column, digest: Column) -> Column:
    """The key of an object: shared/type/first two/hash."""
    return F.concat(F.lit("shared/"), kind, F.lit("/"), F.substring(digest, 1, 2), F.lit("/"), digest)


def retry_ceiling_ms(attempt: Column) -> Column:
    """The longest wait before an attempt (from 0): it doubles from 300 ms, up to 4000."""
    return F.least(F.lit(4000.0), F.lit(300.0) * F.pow(F.lit(2.0), attempt))


def retryable(code: Column) -> Column:
    return code.isin(429, 503)


def clamped_threshold(x: Column, before: Column) -> Column:
    """x within 0.1 and 0.95; the value before where x is null or not finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.1), F.least(F.lit(0.95), x))).otherwise(before)


def shown_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column, Column]:
    """Width and height as shown (swapped for tags 5 to 8) and their ratio, null unless both are positive."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    return w, h, F.when((width > 0) & (height > 0), w / h)


def downsized(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Sides after scaling so that the longer one is at most ``most``; never enlarged. Null unless both are positive."""
    scale = F.when((width > 0) & (height > 0), F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height)))
    return half_up(width * scale), half_up(height * scale)


def letterbox_scale(width: Column, height: Column, side: int = 640) -> Column:
    """Null unless both are positive."""
    return F.when((width > 0) & (height > 0), F.least(F.lit(float(side)) / width, F.lit(float(side)) / height))


def progress_percent(received: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100).cast("long"), half_up(received / total * 100))).otherwise(F.lit(0).cast("long"))


def crop_rectangle(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, padding: float = 0.35) -> dict[str, Column]:
    """A box with padding on all sides, clamped to the frame; at least one pixel wide and high."""
    pad = F.greatest(w, h) * padding
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    left, top = F.greatest(zero, half_up(x - pad)), F.greatest(zero, half_up(y - pad))
    return {"left": left, "top": top, "width": F.greatest(one, F.least(width - left, half_up(w + pad * 2))), "height": F.greatest(one, F.least(height - top, half_up(h + pad * 2)))}


def version_struct(text: Column) -> Column:
    """major.minor.patch as a struct that orders as versions do, without what follows a hyphen; parts that don't start with digits are 0."""
    part = F.split(F.substring_index(text, "-", 1), r"\.")
    number = lambda k: F.regexp_extract(F.try_element_at(part, F.lit(k)), r"^\s*(\d+)", 1).try_cast("int")
    return F.struct(*[F.coalesce(number(k + 1), F.lit(0)).alias(n) for k, n in enumerate(("major", "minor", "patch"))])


def range_floor(text: Column) -> Column:
    """The lowest version that a range like ^1.2.3 or >=1.2.3 takes; null for other forms."""
    return F.nullif(F.regexp_extract(trimmed(text), r"^[\^~>=]*\s*(\d+\.\d+\.\d+)", 1), F.lit(""))


def text_or_null(x: Column) -> Column:
    """A text that isn't empty."""
    return F.nullif(x, F.lit(""))


def number_or_null(x: Column) -> Column:
    """A finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def utf16_units(text: Column) -> Column:
    """The length of a text in UTF-16 units: 2 for code points over U+FFFF."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def camera_text(make: Column, model: Column) -> Column:
    """Maker and model; null without a maker."""
    return F.when(make != "", trimmed(F.concat(make, F.lit(" "), F.coalesce(model, F.lit("")))))


def aperture_text(f_number: Column) -> Column:
    return F.concat(F.lit("f/"), number_text(f_number))


def place_text(lat: Column, lon: Column) -> Column:
    """Five digits after the point each; null unless both are there. Halves of the decimal value are rounded up."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.5f, %.5f", lat, lon))


def date_text(iso: Column) -> Column:
    """A date and time to the second, with a space for the T."""
    at = F.instr(iso, "T")
    return F.substring(F.when(at > 0, F.concat(F.left(iso, at - 1), F.lit(" "), F.substr(iso, at + 1))).otherwise(iso), 1, 19)


#: What the two slots for single files take.
COVER_BYTES, GRAPHIC_BYTES = 20_000_000, 5_000_000
GRAPHIC_TYPES = ("image/png", "image/jpeg", "image/webp", "image/gif")


def slot_refusal(slot: Column, size: Column, content_type: Column) -> Column:
    """Why a slot (cover or style-graphic) doesn't take a file: type, empty or size; null if it does."""
    kind = F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))
    most = F.when(slot == "cover", COVER_BYTES).otherwise(GRAPHIC_BYTES)
    return F.when((slot != "cover") & ~kind.isin(*GRAPHIC_TYPES), "type").when(size == 0, "empty").when(size > most, "size")


def merged_config(patch: Column, base: dict) -> dict[str, Column]:
    """The fields of a configuration after a JSON patch: each is taken if it is of the right type there, else from base."""
    parsed = F.try_parse_json(patch)

    def of(field: str, kinds: str, as_type: str) -> Column:
        path = f"$.faces.{field}"
        fits = F.schema_of_variant(F.try_variant_get(parsed, path, "variant")).rlike(kinds)
        return F.when(fits, F.try_variant_get(parsed, path, as_type))

    return {
        "enabled": F.coalesce(of("enabled", "^BOOLEAN$", "boolean"), F.lit(base["enabled"])),
        "threshold": clamped_threshold(of("threshold", "^(BIGINT|DOUBLE|DECIMAL.*)$", "double"), F.lit(base["threshold"])),
        "publish": F.coalesce(of("publishLabels", "^BOOLEAN$", "boolean"), F.lit(base["publish"])),
    }
