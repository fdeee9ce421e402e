"""The registered queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

from tessera.functions.scalars import ORIENTATIONS, TYPE_BY_EXTENSION, UPLOAD_TYPES
from tessera.operators.store import MODEL
from tessera.sources.adapters import SQL

HALF = "CAST(floor({} + 0.5) AS BIGINT)"

MORE = {
    "images": "images AS (SELECT r.*, coalesce(m.width, 0) AS width, coalesce(m.height, 0) AS height, m.orientation, e.caption, coalesce(e.date_taken_override, m.captured_at, r.created_at) AS effective_date FROM records r LEFT JOIN metadata m ON m.record_id = r.id LEFT JOIN enriched e ON e.record_id = r.id AND r.parent_id IS NULL)",
    "kinds": "kinds AS (SELECT r.id, r.parent_id, k.kind FROM records r LEFT JOIN (SELECT record_id, min(key) AS kind FROM rlabels WHERE app_id = 'gallery' AND key IN ('thumbnail', 'crop') GROUP BY 1) k ON k.record_id = r.id)",
    "originals": "originals AS (SELECT id FROM kinds WHERE parent_id IS NULL AND kind IS NULL)",
    "tiles": "tiles AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY created_at DESC, id) AS n FROM images WHERE parent_id IS NOT NULL) WHERE n = 1)",
    "shown": "shown AS (SELECT * FROM tiles UNION ALL SELECT * FROM images WHERE parent_id IS NULL AND id NOT IN (SELECT parent_id FROM tiles))",
    "names": "names AS (SELECT person_id, trim(name) AS name FROM people WHERE trim(name) <> '' AND strlen(trim(name)) <= 128)",
    "plan": "plan AS (SELECT record_id, 'faceCount' AS key, [CAST(count(*) AS VARCHAR)] AS vals FROM faces WHERE v = 1 GROUP BY 1 UNION ALL SELECT f.record_id, 'faces', list_slice(list_sort(coalesce(list(DISTINCT n.name) FILTER (WHERE n.name IS NOT NULL), [])), 1, 32) FROM faces f LEFT JOIN names n USING (person_id) WHERE f.v = 1 GROUP BY 1)",
    "costs": "costs AS (SELECT record_id, key, greatest(1, len(vals)) AS cost, row_number() OVER (ORDER BY record_id, key) AS k FROM plan)",
    "fit": "fit AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS fill UNION ALL SELECT c.k, CASE WHEN f.fill > 0 AND f.fill + c.cost > 20 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.fill > 0 AND f.fill + c.cost > 20 THEN c.cost ELSE f.fill + c.cost END FROM fit f JOIN costs c ON c.k = f.k + 1)",
    "comps": "comps AS (SELECT vec_id, person_id, record_id, face_index, v, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM faces)",
    "means": "means AS (SELECT person_id, n, pos, m / sqrt(sum(m * m) OVER (PARTITION BY person_id)) AS x FROM (SELECT person_id, pos, avg(x) AS m, count(*) AS n FROM comps GROUP BY 1, 2))",
    "latest": "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS n FROM changes) WHERE n = 1)",
    "boxes": "boxes AS (SELECT img, vec_id, score, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM faces)",
    "pairs": "pairs AS (SELECT *, inter / (a1 + a2 - inter) AS iou FROM (SELECT p.img, p.vec_id AS a, q.vec_id AS b, greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1)) AS inter, (p.x2 - p.x1) * (p.y2 - p.y1) AS a1, (q.x2 - q.x1) * (q.y2 - q.y1) AS a2 FROM boxes p JOIN boxes q ON p.img = q.img AND p.vec_id <> q.vec_id))",
    "ordered": "ordered AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, vec_id) AS k FROM boxes)",
    "over": "over AS (SELECT o.img, o.vec_id, o.k, coalesce(list(p.b) FILTER (WHERE p.iou > 0.1), []) AS others FROM ordered o LEFT JOIN pairs p ON p.img = o.img AND p.a = o.vec_id GROUP BY 1, 2, 3)",
    "nms": "nms AS (SELECT DISTINCT img, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM boxes UNION ALL SELECT n.img, o.k, CASE WHEN list_has_any(n.kept, o.others) THEN n.kept ELSE list_append(n.kept, o.vec_id) END FROM nms n JOIN over o ON o.img = n.img AND o.k = n.k + 1)",
    "raw": "raw AS (SELECT img, vec_id, CAST([8, 16, 32][vec_id % 3 + 1] AS INTEGER) AS stride, vec_id * 7 % 800 AS anchor, score, (vec_id % 5) / 2 AS l, (vec_id % 7) / 2 AS t, (vec_id % 3) / 2 AS r, (vec_id % 4) / 2 AS b FROM faces WHERE score >= 0.6)",
    "decoded": "decoded AS (SELECT img, vec_id, stride, anchor, score, cx - l * stride AS x1, cy - t * stride AS y1, cx + r * stride AS x2, cy + b * stride AS y2, array_to_string(list_transform(range(10), lambda i: CAST(CAST((CASE WHEN i % 2 = 0 THEN cx ELSE cy END) + ((vec_id + i) % 9 - 4) / 4 * stride AS INTEGER) AS VARCHAR)), ',') AS landmarks FROM raw JOIN anchors USING (stride, anchor))",
    "dpairs": "dpairs AS (SELECT *, CASE WHEN a1 + a2 - inter > 0 THEN inter / (a1 + a2 - inter) ELSE 0 END AS iou FROM (SELECT p.img, p.vec_id AS a, q.vec_id AS b, greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1)) AS inter, (p.x2 - p.x1) * (p.y2 - p.y1) AS a1, (q.x2 - q.x1) * (q.y2 - q.y1) AS a2 FROM decoded p JOIN decoded q ON p.img = q.img AND p.vec_id <> q.vec_id))",
    "dordered": "dordered AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, vec_id) AS k FROM decoded)",
    "dover": "dover AS (SELECT o.img, o.vec_id, o.k, coalesce(list(p.b) FILTER (WHERE p.iou > 0.1), []) AS others FROM dordered o LEFT JOIN dpairs p ON p.img = o.img AND p.a = o.vec_id GROUP BY 1, 2, 3)",
    "dnms": "dnms AS (SELECT DISTINCT img, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM decoded UNION ALL SELECT n.img, o.k, CASE WHEN list_has_any(n.kept, o.others) THEN n.kept ELSE list_append(n.kept, o.vec_id) END FROM dnms n JOIN dover o ON o.img = n.img AND o.k = n.k + 1)",
    "tensors": "tensors AS (SELECT doc_id AS img, CAST(s AS INTEGER) AS stride, 2 * (640 // s) * (640 // s) AS rows, w AS wide FROM documents, (SELECT unnest([8, 16, 32]) AS s), (SELECT unnest([1, 4, 10]) AS w))",
    "rects": f"rects AS (SELECT *, greatest(1, least(640 - l, {HALF.format('(w + pad * 2)')})) AS width, greatest(1, least(420 - t, {HALF.format('(h + pad * 2)')})) AS height FROM (SELECT *, greatest(0, {HALF.format('(x - pad)')}) AS l, greatest(0, {HALF.format('(y - pad)')}) AS t FROM (SELECT *, greatest(w, h) * 0.35::DOUBLE AS pad FROM faces)))",
    "app": "app AS (SELECT l.id, coalesce(l.mime_type, 'image/jpeg') AS mime_type, 'shared/' || type || '/' || substr(content_hash, 1, 2) || '/' || content_hash AS object_key, size_bytes, created_at, l.parent_id, k.kind AS derived_kind, coalesce(width, 0) AS width, coalesce(height, 0) AS height, coalesce(original_filename, l.id) AS original_filename, coalesce(date_taken_override, captured_at, created_at) AS effective_date, caption, date_taken_override, captured_at, camera_make, camera_model, f_number, exposure_time, iso, lens_model, gps_lat, gps_lon, orientation FROM listed l JOIN kinds k USING (id) LEFT JOIN metadata m ON m.record_id = l.id LEFT JOIN camera c ON c.record_id = l.id LEFT JOIN enriched e ON e.record_id = l.id AND l.parent_id IS NULL)",
    "anchors": "anchors AS (SELECT s AS stride, i AS anchor, CAST(((i // 2) % (640 // s)) * s AS DOUBLE) AS cx, CAST(((i // 2) // (640 // s)) * s AS DOUBLE) AS cy FROM (SELECT CAST(unnest([8, 16, 32]) AS INTEGER) AS s), range(12800) t(i) WHERE i < 2 * (640 // s) * (640 // s))",
}
NEEDS = {
    "images": "records metadata enriched", "kinds": "records rlabels", "originals": "kinds", "tiles": "images", "shown": "tiles", "names": "people", "plan": "faces names", "costs": "plan", "fit": "costs", "comps": "faces",
    "means": "comps", "latest": "changes", "boxes": "faces", "pairs": "boxes", "ordered": "boxes", "raw": "faces", "decoded": "raw anchors", "dpairs": "decoded", "dordered": "decoded", "dover": "dordered dpairs", "dnms": "dover", "rects": "faces", "listed": "records", "app": "listed kinds metadata camera enriched", "over": "ordered pairs", "nms": "over",
}


def needed(names: str, found: dict[str, None]) -> None:
    for name in names.split():
        if name not in found:
            needed(NEEDS.get(name, ""), found)
            found[name] = None


def sql(names: str, body: str) -> str:
    """A statement over the named common table expressions and what they need."""
    found: dict[str, None] = {}
    needed(names, found)
    return "WITH RECURSIVE " + ",\n".join({**SQL, **MORE}[n] for n in found) + "\n" + body


def case(key: str, known: dict, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in known.items()) + f" ELSE {other} END"


EXTENSION = "CASE WHEN position('.' IN base) > 0 AND length(base) - length(split_part(base, '.', -1)) > 1 AND split_part(base, '.', -1) <> '' THEN lower(split_part(base, '.', -1)) END"
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
TENTHS = "CAST(CAST(round(CAST({} AS DECIMAL(30,12)), 1) AS DECIMAL(30,1)) AS VARCHAR)"
BYTES = "list_transform(embedding, lambda e: (CAST(floor(CAST(e AS DOUBLE) * 1000) AS BIGINT) % 256 + 256) % 256)"
TILE = "id, parent_id, effective_date, width, height"



def clusters(threshold: float) -> str:
    """The online clusters of each image, one face at a time, as a common table expression ``clustered``."""
    return f""", o AS (SELECT img AS scope, vec_id, embedding AS v, row_number() OVER (PARTITION BY img ORDER BY record_id, face_index, vec_id) AS k FROM faces WHERE embedding IS NOT NULL),
 clustered AS (
  SELECT scope, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS vec_id, CAST([] AS FLOAT[][]) AS cs, CAST([] AS BIGINT[]) AS ns, CAST(NULL AS BIGINT) AS cluster, CAST(NULL AS BIGINT) AS size, CAST(NULL AS DOUBLE) AS score FROM (SELECT DISTINCT scope FROM o)
  UNION ALL
  SELECT scope, k, vec_id, CASE WHEN joined THEN list_transform(cs, lambda c, i: CASE WHEN i = b THEN updated ELSE c END) ELSE list_append(cs, v) END,
    CASE WHEN joined THEN list_transform(ns, lambda n, i: CASE WHEN i = b THEN n + 1 ELSE n END) ELSE list_append(ns, 1) END,
    CASE WHEN joined THEN b - 1 ELSE len(cs) END, CASE WHEN joined THEN ns[b] + 1 ELSE 1 END, CASE WHEN joined THEN best END
  FROM (SELECT *, list_transform(mean, lambda x: CAST(CAST(x AS DOUBLE) / sqrt({DOT.format('mean', 'mean')}) AS FLOAT)) AS updated
   FROM (SELECT *, coalesce(best >= {threshold}, false) AS joined, list_transform(list_zip(cs[b], v), lambda p: CAST((CAST(p[1] AS DOUBLE) * ns[b] + CAST(p[2] AS DOUBLE)) / (ns[b] + 1) AS FLOAT)) AS mean
    FROM (SELECT *, list_max(ss) AS best, len(ss) - list_position(list_reverse(ss), list_max(ss)) + 1 AS b
     FROM (SELECT r.scope, o.k, o.vec_id, o.v, r.cs, r.ns, list_transform(r.cs, lambda c: {DOT.format('c', 'o.v')}) AS ss FROM clustered r JOIN o ON o.scope = r.scope AND o.k = r.k + 1)))))"""


ORACLE_SQL = {
    "online_clusters": sql("faces", clusters(0.3) + " SELECT scope, vec_id, cluster, size, round(score, 5) AS score FROM clustered WHERE k > 0"),
    "recluster_all": sql("faces", clusters(0.2) + " SELECT scope, count(*) AS n, count(DISTINCT cluster) AS clusters FROM clustered WHERE k > 0 GROUP BY 1"),
    "warped_crops": f"""WITH g AS (SELECT vec_id AS k, {BYTES} AS bytes, y, x, c, (0.5 * (x + 0.5 - 0.3) - 0.1 * (y + 0.5 - 0.2)) / 0.26 - 0.5 AS sx, (0.1 * (x + 0.5 - 0.3) + 0.5 * (y + 0.5 - 0.2)) / 0.26 - 0.5 AS sy
  FROM embeddings, (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS x), (SELECT unnest(range(3)) AS c)),
 n AS (SELECT *, CAST(floor(sx) + dx AS BIGINT) AS px, CAST(floor(sy) + dy AS BIGINT) AS py, abs(1 - dx - (sx - floor(sx))) * abs(1 - dy - (sy - floor(sy))) AS weight FROM g, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)),
 p AS (SELECT k, y, x, c, sum(weight * bytes[least(greatest(py, 0), 3) * 15 + least(greatest(px, 0), 4) * 3 + c + 1]) AS v FROM n GROUP BY 1, 2, 3, 4)
SELECT k AS id, string_agg(printf('%02X', CAST(floor(v + 0.5) AS BIGINT)), '' ORDER BY y, x, c) AS crop FROM p GROUP BY 1""",
    "display_list": sql("shown", f"SELECT {TILE} FROM shown"),
    "display_list_typed": sql(
        "images kinds",
        f""", typed AS (SELECT i.* FROM images i JOIN kinds k USING (id) WHERE i.parent_id IS NULL OR k.kind = 'thumbnail'),
  t2 AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY created_at DESC, id) AS n FROM typed WHERE parent_id IS NOT NULL) WHERE n = 1)
SELECT {TILE} FROM t2 UNION ALL SELECT {TILE} FROM typed WHERE parent_id IS NULL AND id NOT IN (SELECT parent_id FROM t2)""",
    ),
    "timeline_by_day": sql("shown", "SELECT substr(effective_date, 1, 10) AS day, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM shown GROUP BY 1"),
    "scan_set_originals": sql("originals", "SELECT id FROM originals"),
    "derived_kind": sql("kinds", "SELECT id, kind FROM kinds"),
    "label_presence": sql("records rlabels", "SELECT id FROM records WHERE id IN (SELECT record_id FROM rlabels WHERE app_id = 'gallery' AND key = 'crop')"),
    "label_value_match": sql("records rlabels", "SELECT id FROM records WHERE id IN (SELECT record_id FROM rlabels WHERE app_id = 'curation' AND key = 'quality' AND value = '1')"),
    "label_rendered": sql("rlabels", "SELECT record_id, app_id || '/' || key AS label, value FROM rlabels"),
    "records_with_labels": sql("records rlabels", "SELECT r.id, count(l.key) AS n_labels, coalesce(string_agg(l.app_id || '/' || l.key || '=' || l.value, ',' ORDER BY l.app_id, l.key, l.value), '') AS labels FROM records r LEFT JOIN rlabels l ON l.record_id = r.id GROUP BY 1"),
    "assembled_records": sql("images", "SELECT * FROM images"),
    "point_lookup": sql("images", "SELECT * FROM images WHERE id = 'rec-00000056'"),
    "catalog_page": sql("records", "SELECT id, created_at FROM records WHERE id > 'rec-00000050' ORDER BY id LIMIT 100"),
    "changes_since_cursor": sql("records", "SELECT id, created_at FROM records WHERE created_at > '2024-01-20T00:00:00' ORDER BY created_at, id LIMIT 500"),
    "max_cursor": sql("records", "SELECT max(created_at) AS cursor FROM records"),
    "types_granted": sql("records", "SELECT id, type FROM records WHERE type IN ('image/jpeg', 'image/png', 'image/gif', 'image/webp', 'image/heic', 'image/heif', 'image/avif', 'image/bmp', 'image/tiff')"),
    "child_to_parent": sql("records", "SELECT r.id, coalesce(p.id, r.id) AS shown_id FROM records r LEFT JOIN records p ON p.id = r.parent_id"),
    "can_thumbnail": sql("kinds", "SELECT id, coalesce(kind <> 'thumbnail', true) AS allowed FROM kinds UNION ALL SELECT 'rec-x', true"),
    "thumbnail_lookup": sql("kinds", "SELECT parent_id, min(id) AS thumbnail_id FROM kinds WHERE kind = 'thumbnail' AND parent_id IS NOT NULL GROUP BY 1"),
    "url_batches": sql("faces records", ", ids AS (SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 100 AS BIGINT) AS batch FROM (SELECT DISTINCT record_id AS id FROM faces)) SELECT id, batch, content_hash FROM ids JOIN records USING (id)"),
    "pending_scan": sql("originals faces", "SELECT id FROM originals WHERE id NOT IN (SELECT record_id FROM faces WHERE v = 1)"),
    "orphan_sidecars": sql("originals faces", "SELECT DISTINCT record_id FROM faces WHERE record_id NOT IN (SELECT id FROM originals) AND (SELECT count(*) FROM originals) > 0"),
    "store_status": sql("faces people", "SELECT *, greatest(stored - processed, 0) AS stale FROM (SELECT count(DISTINCT record_id) AS stored, count(DISTINCT CASE WHEN v = 1 THEN record_id END) AS processed, count(*) FILTER (WHERE v = 1) AS faces FROM faces), (SELECT count(*) AS people, count(*) FILTER (WHERE trim(name) <> '') AS named_people FROM people)"),
    "pass_counts": sql("originals faces", "SELECT CASE WHEN v = 1 THEN 'skipped' WHEN v IS NOT NULL THEN 'stale' ELSE 'new' END AS outcome, count(*) AS n FROM originals LEFT JOIN (SELECT record_id AS id, max(v) AS v FROM faces GROUP BY 1) USING (id) GROUP BY 1"),
    "untiled_originals": sql("tiles", "SELECT id FROM images WHERE parent_id IS NULL AND id NOT IN (SELECT parent_id FROM tiles) AND doc_id % 3 <> 0"),
    "toggled_selection": sql("records", "SELECT id FROM records WHERE (doc_id % 6 = 0) <> (doc_id % 4 = 0)"),
    "content_dedup": sql("records", "SELECT id, content_hash, 'shared/' || type || '/' || substr(content_hash, 1, 2) || '/' || content_hash AS object_key, id <> min(id) OVER w AS deduped, min(id) OVER w AS first_id FROM records WINDOW w AS (PARTITION BY content_hash)"),
    "upsert_merge": sql("changes", ", odd AS (SELECT *, event_id % 2 AS o, row_number() OVER (PARTITION BY id, event_id % 2 ORDER BY ts DESC, event_id DESC) AS n FROM changes) SELECT id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC) AS k FROM odd WHERE n = 1) WHERE k = 1"),
    "partial_upsert": sql("enriched", ", p AS (SELECT 'rec-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS record_id, doc_id, CASE WHEN doc_id % 11 = 0 THEN repeat('x', CAST(2000 + doc_id % 2 AS INTEGER)) WHEN doc_id % 2 = 0 THEN 'new ' || doc_id END AS given FROM documents WHERE doc_id % 7 = 0 AND NOT (doc_id % 3 <> 0 AND doc_id % 11 = 0 AND doc_id % 2 = 1)) SELECT record_id, CASE WHEN p.doc_id % 3 <> 0 THEN given ELSE caption END AS caption, CASE WHEN p.doc_id % 5 = 0 THEN NULL ELSE date_taken_override END AS date_taken_override FROM enriched FULL JOIN p USING (record_id)"),
    "label_add": sql("rlabels", "SELECT record_id, app_id, key, value FROM rlabels UNION SELECT record_id, 'gallery', key, value FROM rlabels WHERE app_id = 'other'"),
    "thumbnail_plan": sql("kinds", "SELECT id AS target_id, 'thumb-' || id AS thumbnail_id FROM kinds WHERE kind IS DISTINCT FROM 'thumbnail' AND id NOT IN (SELECT parent_id FROM kinds WHERE kind = 'thumbnail' AND parent_id IS NOT NULL)"),
    "metadata_writes": sql("metadata", "SELECT record_id, 'captured_at' AS field, captured_at AS value FROM metadata WHERE captured_at IS NOT NULL UNION ALL SELECT record_id, 'orientation', CAST(orientation AS VARCHAR) FROM metadata WHERE orientation IS NOT NULL"),
    "metadata_backfill": sql("images", "SELECT id FROM images WHERE width = 0"),
    "delete_records": sql("originals", "SELECT id FROM records WHERE id NOT IN (SELECT id FROM originals)"),
    "publish_plan": sql("plan", "SELECT record_id, key, array_to_string(vals, '|') AS shown, len(vals) AS n_values FROM plan"),
    "publish_batches": sql("fit", "SELECT record_id, key, batch FROM fit JOIN costs USING (k)"),
    "publish_summary": sql("fit", "SELECT (SELECT count(*) FROM plan) AS records_written, (SELECT count(*) FROM plan WHERE key = 'faceCount' AND len(vals) > 0) AS images_with_faces, (SELECT count(DISTINCT v) FROM (SELECT unnest(vals) AS v FROM plan WHERE key = 'faces')) AS names_published, (SELECT max(batch) + 1 FROM fit) AS batches"),
    "retract_plan": sql("faces", "SELECT DISTINCT record_id, key, CAST(0 AS BIGINT) AS n_values FROM faces, (SELECT unnest(['faceCount', 'faces']) AS key) WHERE v = 1"),
    "label_set_diff": sql("plan", ", want AS (SELECT DISTINCT record_id, key, unnest(vals) AS value FROM plan), old AS (SELECT record_id, 'faceCount' AS key, '2' AS value FROM faces WHERE vec_id % 3 = 0 UNION SELECT record_id, 'faces', 'Old' FROM faces WHERE vec_id % 5 = 0), there AS (SELECT * FROM old WHERE (record_id, key) IN (SELECT (record_id, key) FROM plan)) SELECT record_id, key, value, CASE WHEN t.o IS NULL THEN 'insert' WHEN w.o IS NULL THEN 'tombstone' ELSE 'keep' END AS op FROM (SELECT *, 1 AS o FROM want) w FULL JOIN (SELECT *, 1 AS o FROM there) t USING (record_id, key, value)"),
    "vector_matches_over_threshold": f"SELECT q.vec_id AS query_id, e.vec_id, round({DOT.format('q.embedding', 'e.embedding')}, 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 AND {DOT.format('q.embedding', 'e.embedding')} >= 0.3",
    "vector_best_match": sql("means", ", s AS (SELECT c.vec_id, m.person_id, sum(c.x * m.x) AS score FROM comps c JOIN means m USING (pos) WHERE c.v = 1 GROUP BY 1, 2) SELECT vec_id, person_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, person_id DESC) AS n FROM s) WHERE n = 1 AND score >= 0.1"),
    "vector_norms": f"SELECT vec_id, round(sqrt(d), 6) AS norm, CAST(pos - 1 AS INTEGER) AS pos, round(x / sqrt(d), 6) + 0 AS x FROM (SELECT vec_id, {DOT.format('embedding', 'embedding')} AS d, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)",
    "centroid_by_label": sql("means", "SELECT person_id, n, CAST(pos - 1 AS INTEGER) AS pos, round(x, 5) + 0 AS x FROM means"),
    "base64_roundtrip": "SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE vec_id % 50 > 1) UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE vec_id % 50 <= 1",
    "people_ranked": sql("people faces", "SELECT p.person_id, p.name, p.created_at, count(f.vec_id) AS faces, count(DISTINCT f.record_id) AS records FROM people p LEFT JOIN faces f ON f.person_id = p.person_id GROUP BY 1, 2, 3"),
    "faces_top_k": sql("faces", "SELECT * FROM (SELECT person_id, vec_id, score, CAST(row_number() OVER (PARTITION BY person_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM faces) WHERE rank <= 60"),
    "face_projection": sql("faces people", "SELECT f.record_id, f.face_index, f.x, f.y, f.w, f.h, f.score, f.person_id, coalesce(p.name, '') AS name FROM faces f LEFT JOIN people p USING (person_id)"),
    "merge_people": sql("means people", ", r AS (SELECT person_id, name, n AS face_count, pos, x FROM means JOIN people USING (person_id)), m AS (SELECT pos, sum(x * face_count) / sum(face_count) AS x FROM r WHERE person_id IN ('1', '2', '5') GROUP BY 1) SELECT person_id, name, face_count, CAST(pos - 1 AS INTEGER) AS pos, round(x, 5) + 0 AS x FROM r WHERE person_id NOT IN ('1', '2', '5') UNION ALL SELECT '1', coalesce((SELECT name FROM people WHERE person_id IN ('1', '2', '5') AND trim(name) <> '' ORDER BY person_id <> '1', person_id LIMIT 1), ''), CAST((SELECT sum(face_count) FROM r WHERE pos = 1 AND person_id IN ('1', '2', '5')) AS BIGINT), CAST(pos - 1 AS INTEGER), round(x / sqrt((SELECT sum(x * x) FROM m)), 5) + 0 FROM m"),
    "split_people": sql("means", ", lost AS (SELECT person_id, count(*) AS lost FROM faces WHERE vec_id % 4 = 0 GROUP BY 1), m AS (SELECT pos, avg(x) AS x FROM comps WHERE vec_id % 4 = 0 GROUP BY 1) SELECT person_id, n - coalesce(lost, 0) AS face_count, CAST(pos - 1 AS INTEGER) AS pos, round(x, 5) + 0 AS x FROM means LEFT JOIN lost USING (person_id) WHERE lost IS NULL OR n > lost UNION ALL SELECT 'new', (SELECT CAST(sum(lost) AS BIGINT) FROM lost), CAST(pos - 1 AS INTEGER), round(x / sqrt((SELECT sum(x * x) FROM m)), 5) + 0 FROM m"),
    "reconcile_people": sql("comps people", ", k AS (SELECT person_id, pos, avg(x) AS m, count(*) AS n FROM comps WHERE v = 1 AND person_id <> '3' GROUP BY 1, 2) SELECT person_id, n AS face_count, CAST(pos - 1 AS INTEGER) AS pos, round(x, 5) + 0 AS x FROM (SELECT person_id, n, pos, m / sqrt(sum(m * m) OVER (PARTITION BY person_id)) AS x FROM k) JOIN people USING (person_id)"),
    "rename_person": sql("people", "SELECT person_id, CASE WHEN person_id = '3' THEN 'Ann' ELSE name END AS name FROM people"),
    "anchor_grid": sql("anchors raw", "SELECT stride, anchor, cx, cy, count(vec_id) AS n FROM anchors LEFT JOIN raw USING (stride, anchor) GROUP BY ALL"),
    "decode_boxes": sql("decoded", "SELECT img, stride, anchor, score, x1, y1, x2, y2, landmarks FROM decoded"),
    "iou_pairs": sql("pairs", "SELECT img, a, b, round(iou, 6) AS iou FROM pairs WHERE a < b AND iou > 0.1"),
    "nms_keep": sql("nms", "SELECT img, vec_id, CAST(place - 1 AS INTEGER) AS place FROM (SELECT img, unnest(kept) AS vec_id, generate_subscripts(kept, 1) AS place FROM (SELECT img, kept FROM nms QUALIFY row_number() OVER (PARTITION BY img ORDER BY k DESC) = 1))"),
    "umeyama_fit": sql("faces", """, p AS (SELECT img, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(dx) AS mu, avg(dy) AS mv, covar_pop(dx, x) + covar_pop(dy, y) AS al, covar_pop(dy, x) - covar_pop(dx, y) AS ac, var_pop(x) + var_pop(y) AS sp
  FROM (SELECT img, x, y, x * 0.5::DOUBLE - y * 0.25::DOUBLE + vec_id % 3 AS dx, x * 0.25::DOUBLE + y * 0.5::DOUBLE + vec_id % 2 AS dy FROM faces) GROUP BY 1 HAVING count(*) >= 2),
 t AS (SELECT *, CASE WHEN sp > 0 THEN al / sp ELSE cos(atan2(ac, al)) END AS a, CASE WHEN sp > 0 THEN ac / sp ELSE sin(atan2(ac, al)) END AS c FROM p)
SELECT img, n, round(a, 5) AS a, round(-c, 5) AS b, round(c, 5) AS c, round(a, 5) AS d, round(mu - a * mx + c * my, 5) AS tx, round(mv - c * mx - a * my, 5) AS ty FROM t"""),
    "affine_roundtrip": sql("faces", "SELECT vec_id, round((2 * (x - 3) + 0.5::DOUBLE * (y + 1)) / 4.25::DOUBLE, 6) + 0 AS u, round((-0.5::DOUBLE * (x - 3) + 2 * (y + 1)) / 4.25::DOUBLE, 6) + 0 AS v, x, y FROM faces"),
    "crop_rects": sql("rects", "SELECT vec_id, l AS left, t AS top, width, height FROM rects"),
    "percent_boxes": sql("faces", "SELECT vec_id, round(x / 640 * 100, 6) AS x, round(y / 480 * 100, 6) AS y, round(w / 640 * 100, 6) AS w, round(h / 480 * 100, 6) AS h FROM faces"),
    "display_dims": sql("images", f"SELECT id, CASE WHEN orientation BETWEEN 5 AND 8 THEN height ELSE width END AS w, CASE WHEN orientation BETWEEN 5 AND 8 THEN width ELSE height END AS h, CASE WHEN width > 0 AND height > 0 THEN round(CASE WHEN orientation BETWEEN 5 AND 8 THEN height / width ELSE width / height END, 6) END AS ratio, CASE WHEN width > 0 AND height > 0 THEN {HALF.format('width * least(1.0::DOUBLE, 1024.0::DOUBLE / greatest(width, height))')} END AS small_w, CASE WHEN width > 0 AND height > 0 THEN {HALF.format('height * least(1.0::DOUBLE, 1024.0::DOUBLE / greatest(width, height))')} END AS small_h, CASE WHEN width > 0 AND height > 0 THEN round(least(640.0::DOUBLE / width, 640.0::DOUBLE / height), 6) END AS scale FROM images"),
    "exif_dates": sql("records", "SELECT id, CASE WHEN doc_id % 9 <> 0 AND doc_id % 4 <> 0 THEN created_at END AS taken FROM records"),
    "exposure_text": sql("records", f"SELECT id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 5 > 0 THEN (doc_id % 5) || 's' END ELSE '1/' || {HALF.format('1 / (1.0::DOUBLE / (doc_id % 500 + 2))')} || 's' END AS exposure FROM records"),
    "file_types": sql("records", f", b AS (SELECT *, split_part(filename, '/', -1) AS base FROM records), x AS (SELECT *, {EXTENSION} AS extension FROM b) SELECT id, extension, {case('extension', TYPE_BY_EXTENSION, chr(39) + 'image/jpeg' + chr(39))} AS by_name, {case(chr(108) + 'ower(split_part(filename, ' + chr(39) + '.' + chr(39) + ', -1))', UPLOAD_TYPES, 'CASE WHEN doc_id % 2 = 0 THEN ' + chr(39) + 'text/x' + chr(39) + ' ELSE ' + chr(39) + 'application/octet-stream' + chr(39) + ' END')} AS upload FROM x"),
    "info_texts": sql("images", f"SELECT id, CASE WHEN size_bytes * 1000 < 1024 THEN size_bytes * 1000 || ' B' WHEN size_bytes * 1000 < 1048576 THEN {TENTHS.format('size_bytes * 1000 / 1024')} || ' KB' ELSE {TENTHS.format('size_bytes * 1000 / 1048576')} || ' MB' END AS size, CASE WHEN width > 0 AND height > 0 THEN {TENTHS.format('width::DOUBLE * height / 1000000')} || ' MP' END AS pixels, CASE WHEN orientation IS NOT NULL THEN {case('orientation', ORIENTATIONS, chr(39) + 'Unknown (' + chr(39) + ' || orientation || ' + chr(39) + ')' + chr(39))} END AS orientation FROM images"),
    "retry_envelope": sql("changes", ", n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) - 1 AS attempt, floor(max(value) OVER (PARTITION BY id)) AS total FROM changes) SELECT event_id, least(4000.0::DOUBLE, 300.0::DOUBLE * pow(2, attempt)) AS most_ms, 427 + event_id % 8 IN (429, 503) AS again, CASE WHEN total > 0 THEN least(100, CAST(floor(floor(value) / total * 100 + 0.5) AS BIGINT)) ELSE 0 END AS percent FROM n"),
    "threshold_clamp": sql("changes", "SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN 0.45::DOUBLE ELSE greatest(0.1::DOUBLE, least(0.95::DOUBLE, value / 100)) END AS threshold FROM changes"),
    "freshness_snapshot": sql("latest", "SELECT id, event_id, event_type FROM latest"),
    "events_by_hour": sql("changes", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM changes GROUP BY 1, 2"),
    "toggle_edges": sql("changes", ", f AS (SELECT *, event_id % 3 > 0 AS flag, lag(event_id % 3 > 0, 1, false) OVER (PARTITION BY id ORDER BY ts, event_id) AS b FROM changes) SELECT id, event_id, CASE WHEN flag THEN 'publish' ELSE 'retract' END AS action FROM f WHERE flag <> b"),
    "detect_faces": sql("dnms", "SELECT img, CAST(place - 1 AS INTEGER) AS place, vec_id FROM (SELECT img, unnest(kept) AS vec_id, generate_subscripts(kept, 1) AS place FROM (SELECT img, kept FROM dnms QUALIFY row_number() OVER (PARTITION BY img ORDER BY k DESC) = 1))"),
    "tensor_kinds": sql("tensors", "SELECT img, CAST(rows * 100 + wide AS BIGINT) AS tensor_id, CASE wide WHEN 1 THEN 'score' WHEN 4 THEN 'box' ELSE 'landmarks' END AS kind, stride FROM tensors UNION ALL SELECT doc_id, 0, NULL, NULL FROM documents"),
    "grouped_heads": sql("tensors", "SELECT img, stride, CAST(rows * 100 + 1 AS BIGINT) AS score, CAST(rows * 100 + 4 AS BIGINT) AS box, CAST(rows * 100 + 10 AS BIGINT) AS landmarks FROM tensors WHERE wide = 1"),
    "unletterboxed": sql("decoded", "SELECT vec_id, round(x1 / s, 6) + 0 AS x, round(y1 / s, 6) + 0 AS y, round(x2 / s - x1 / s, 6) + 0 AS w, round(y2 / s - y1 / s, 6) + 0 AS h FROM (SELECT *, least(640.0::DOUBLE / (vec_id % 5 * 100 + 640), 640.0::DOUBLE / 480) AS s FROM decoded)"),
    "template_fit": sql("faces", "SELECT vec_id, CAST(5 AS BIGINT) AS n, round(1.0::DOUBLE / (vec_id % 3 + 1), 5) AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, round(1.0::DOUBLE / (vec_id % 3 + 1), 5) AS d, round(-(vec_id % 7)::DOUBLE / (vec_id % 3 + 1), 5) + 0 AS tx, round(-(vec_id % 5)::DOUBLE / (vec_id % 3 + 1), 5) + 0 AS ty FROM faces"),
    "pixel_planes": f"SELECT vec_id, CAST((i % 3) * 4 + i // 3 AS INTEGER) AS pos, ({BYTES}[i + 1] - 127.5::DOUBLE) / 128 AS x FROM embeddings, range(12) t(i)",
    "split_faces": sql("faces", "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'new' ELSE person_id END AS person_id FROM faces"),
    "merge_people_faces": sql("faces", "SELECT vec_id, CASE WHEN person_id IN ('2', '5') THEN '1' ELSE person_id END AS person_id FROM faces"),
    "app_row": sql("enriched", "SELECT * FROM enriched WHERE record_id = 'rec-00000056'"),
    "app_images": sql("app", "SELECT * FROM app"),
    "info_panel": sql("app", "SELECT id, original_filename, width || ' × ' || height || 'px' AS dimensions, substr(replace(effective_date, 'T', ' '), 1, 19) AS date_taken, CASE WHEN camera_make <> '' THEN trim(camera_make || ' ' || coalesce(camera_model, '')) END AS camera, 'f/' || CASE WHEN f_number = floor(f_number) THEN CAST(CAST(f_number AS BIGINT) AS VARCHAR) ELSE CAST(f_number AS VARCHAR) END AS aperture, exposure_time AS exposure, iso, CASE WHEN gps_lat IS NOT NULL AND gps_lon IS NOT NULL THEN printf('%.5f, %.5f', gps_lat, gps_lon) END AS place FROM app"),
    "requested_urls": sql("records faces", "SELECT id, 'shared/' || type || '/' || substr(content_hash, 1, 2) || '/' || content_hash AS object_key FROM records WHERE id IN (SELECT record_id FROM faces)"),
    "crop_records": sql("rects", "SELECT 'crop-' || record_id || '-' || face_index AS id, record_id AS parent_id, 'image/jpeg' AS type, 'gallery' AS app_id, 'crop' AS key, width, height FROM rects"),
    "slot_guards": sql("records", "SELECT id, slot, CASE WHEN slot <> 'cover' AND kind NOT IN ('image/png', 'image/jpeg', 'image/webp', 'image/gif') THEN 'type' WHEN size = 0 THEN 'empty' WHEN size > CASE WHEN slot = 'cover' THEN 20000000 ELSE 5000000 END THEN 'size' END AS refused FROM (SELECT id, CASE WHEN doc_id % 4 < 2 THEN 'cover' ELSE 'style-graphic' END AS slot, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE doc_id * 25000 END AS size, (['image/png', 'image/svg+xml', 'image/gif', 'text/x', '', 'image/webp'])[doc_id % 6 + 1] AS kind FROM records)"),
    "sidecar_reads": sql("sidecars", f"SELECT record_id, v, model, CAST(n_faces AS BIGINT) AS n_faces, v = 1 AND model = '{MODEL}' AS current FROM sidecars"),
    "sidecar_status": sql("sidecars", f"SELECT count(*) AS on_disk, count(*) FILTER (WHERE own) AS processed, count(*) FILTER (WHERE own AND n_faces > 0) AS images_with_faces, CAST(coalesce(sum(n_faces) FILTER (WHERE own), 0) AS BIGINT) AS faces FROM (SELECT *, v = 1 AND model = '{MODEL}' AS own FROM sidecars)"),
    "sidecar_pending": sql("originals sidecars", f"SELECT id FROM originals WHERE id NOT IN (SELECT record_id FROM sidecars WHERE v = 1 AND model = '{MODEL}')"),
    "sidecar_publish_plan": sql("sidecars names", f", own AS (SELECT s.*, n.name FROM sidecars s LEFT JOIN names n USING (person_id) WHERE v = 1 AND model = '{MODEL}') SELECT record_id, 'faceCount' AS key, CASE WHEN n_faces > 0 THEN CAST(n_faces AS VARCHAR) ELSE '' END AS shown, CAST(CASE WHEN n_faces > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_values FROM own UNION ALL SELECT record_id, 'faces', CASE WHEN n_faces > 0 THEN coalesce(name, '') ELSE '' END, CAST(CASE WHEN n_faces > 0 AND name IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) FROM own"),
    "missing_models": "SELECT 'model-' || p_partkey AS name, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 15 = 0 OR p_partkey % 10 = 0",
    "model_totals": "SELECT CAST(sum(p_size) AS BIGINT) AS total_bytes, CAST(coalesce(sum(p_size) FILTER (WHERE gone), 0) AS BIGINT) AS missing_bytes, count(*) FILTER (WHERE gone) AS n_missing, count(*) FILTER (WHERE gone) = 0 AS installed FROM (SELECT *, p_partkey % 15 = 0 OR p_partkey % 10 = 0 AS gone FROM part)",
    "verified_files": "SELECT doc_id FROM documents WHERE sha256(text) = sha256(CASE WHEN doc_id % 3 = 0 THEN text || '.' ELSE text END)",
    "enabled_tasks": "SELECT r_name AS task, r_regionkey FROM region WHERE r_regionkey % 2 = 0",
    "manifest_keys": sql("records", "SELECT id AS key, CASE WHEN doc_id % 3 > 0 THEN 'manifest' ELSE 'code' END AS only_in FROM records WHERE (doc_id % 3 > 0) <> (doc_id % 5 > 0)"),
    "isolated_failures": sql("records", ", t AS (SELECT id, CASE WHEN doc_id % 8 = 0 THEN 'bad ' || created_at ELSE substr(created_at, 1, 10) END AS text FROM records) SELECT id, TRY_CAST(text AS DATE) AS day, TRY_CAST(text AS DATE) IS NULL AS failed FROM t"),
    "exif_coercion": sql("changes", ", g AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type END AS text, CASE WHEN event_id % 5 = 0 THEN 'nan'::DOUBLE WHEN event_id % 5 = 1 THEN '-inf'::DOUBLE WHEN event_id % 5 > 2 THEN value END AS number FROM changes) SELECT event_id, nullif(text, '') AS make, CASE WHEN isfinite(number) THEN number END AS iso FROM g"),
    "version_checks": "SELECT p_partkey, floor, (p_partkey % 3, p_partkey % 13, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey % 5 END) < CASE p_partkey % 5 WHEN 0 THEN (1, 2, 3) WHEN 1 THEN (1, 10, 0) WHEN 2 THEN (1, 2, 2) WHEN 4 THEN (2, 0, 1) END AS older FROM (SELECT p_partkey, (['1.2.3', '1.10.0', '1.2.2', NULL, '2.0.1'])[p_partkey % 5 + 1] AS floor FROM part)",
    "merged_config": sql("changes", "SELECT event_id, event_id % 7 <> 0 AS enabled, CASE event_id % 7 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.95::DOUBLE WHEN 6 THEN 0.1::DOUBLE ELSE 0.45::DOUBLE END AS threshold, event_id % 7 = 1 AS publish FROM changes"),
}
# A body that starts with a comma goes on with the list of expressions.
ORACLE_SQL = {k: v.replace("\n,", ",", 1) if "\n, " in v else v for k, v in ORACLE_SQL.items()}
