"""The catalogue's queries in DuckDB SQL."""

from __future__ import annotations

from .tables import HEIGHT, WIDTH

PHOTOS = """photos AS MATERIALIZED (SELECT event_id AS photo_id, epoch_us(ts) AS us, CASE WHEN event_id % 7 < 5 THEN 'b' || (event_id // 3) END AS burst_id,
    xor((event_id // 4 % 2147483648) * 2654435761 % 4294967296, (1::BIGINT << (event_id % 5 * 3)) - 1) AS phash FROM events)"""
DELTA = """delta AS MATERIALIZED (SELECT least(greatest(3.0::DOUBLE * coalesce(quantile_cont(gap, 0.5), 2.0), 0.3), 30.0)::DOUBLE AS delta_s FROM
    (SELECT ((us - lag(us) OVER (ORDER BY us, photo_id)) // 1000)::DOUBLE / 1000 AS gap FROM photos WHERE us IS NOT NULL) WHERE gap IS NOT NULL)"""
CANDIDATES = """candidates AS MATERIALIZED (SELECT a.photo_id AS a, b.photo_id AS b FROM photos a JOIN photos b ON a.us <= b.us AND b.us <= a.us + 30001000
    WHERE (a.us < b.us OR a.photo_id < b.photo_id) AND ((b.us - a.us) // 1000)::DOUBLE / 1000 <= (SELECT delta_s FROM delta))"""


def mixed(ids: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT photo_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-8)) AS e FROM
    (SELECT i.photo_id, list_transform(list_zip(p.embedding, q.embedding), lambda z: z[1]::DOUBLE + 0.1::DOUBLE * (i.photo_id % 5) * z[2]::DOUBLE) AS v
     FROM ({ids}) i, (SELECT count(*) AS n FROM embeddings) c JOIN embeddings p ON p.vec_id = i.photo_id // 4 % c.n JOIN embeddings q ON q.vec_id = (i.photo_id * 7 + 3) % c.n))"""


FEATURES = mixed("SELECT photo_id FROM photos", "features")
#: Arrays of a fixed length are multiplied many times faster than lists.
VECTORS = "vectors AS MATERIALIZED (SELECT photo_id, e::DOUBLE[64] AS e FROM survivors)"
SURVIVORS = mixed("SELECT vec_id AS photo_id FROM embeddings", "survivors")


def edges(similarity: float) -> str:
    return f"edges AS MATERIALIZED (SELECT a, b FROM candidates JOIN features f ON f.photo_id = a JOIN features g ON g.photo_id = b WHERE list_inner_product(f.e, g.e) > {similarity})"


FORCED = """pairs AS MATERIALIZED (SELECT i.photo_id AS a, j.photo_id AS b, i.us AS a_us, j.us AS b_us, i.burst_id FROM photos i JOIN photos j ON i.burst_id = j.burst_id AND (i.us < j.us OR i.us = j.us AND i.photo_id < j.photo_id)),
  stopped AS (SELECT DISTINCT a, b FROM pairs JOIN photos k ON k.us > a_us AND (k.us < b_us OR k.us = b_us AND k.photo_id < b)
     WHERE k.burst_id IS DISTINCT FROM pairs.burst_id AND ((k.us - a_us) // 1000)::DOUBLE / 1000 > (SELECT delta_s FROM delta)),
  every AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT a, b FROM pairs ANTI JOIN stopped USING (a, b))"""


def groups(source: str = "edges") -> str:
    return f"""both_ways AS MATERIALIZED (SELECT a, b FROM {source} UNION SELECT b, a FROM {source}),
  reach(node, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT b, root FROM reach JOIN both_ways ON a = node),
  part AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
  grouped AS (SELECT photo_id, us, coalesce(root, photo_id) AS group_id FROM photos LEFT JOIN part ON node = photo_id)"""


BURSTS = "SELECT photo_id, group_id, first_value(photo_id) OVER (PARTITION BY group_id ORDER BY us, photo_id) AS representative FROM grouped"


def chain(*parts: str, then: str) -> str:
    return ("WITH RECURSIVE " if any("reach(" in p for p in parts) else "WITH ") + ",\n  ".join(parts) + "\n" + then


def clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)::DOUBLE"


FACES = """faces AS MATERIALIZED (SELECT l_orderkey AS photo_id, l_linenumber AS k, l_discount AS area, l_tax * 12 AS eye, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 8 END AS smile, l_quantity AS sharp FROM lineitem)"""
PER_PHOTO = """per_photo AS MATERIALIZED (SELECT o_orderkey AS photo_id, count(f.photo_id) AS n, coalesce(max(area), 0.0)::DOUBLE AS largest FROM orders LEFT JOIN faces f ON f.photo_id = o_orderkey GROUP BY o_orderkey)"""
SCENE = "CASE WHEN n >= 1 AND largest >= 0.05 THEN 'portrait' WHEN n = 0 THEN 'landscape' ELSE 'mixed' END"


def weight(portrait: float, landscape: float, mixed_: float) -> str:
    return f"(CASE WHEN n = 0 THEN {landscape} WHEN largest >= 0.05 THEN {portrait} WHEN largest <= 0.02 THEN {mixed_} ELSE {mixed_}::DOUBLE + (largest - 0.02) / (0.05::DOUBLE - 0.02::DOUBLE) * ({portrait}::DOUBLE - {mixed_}::DOUBLE) END)::DOUBLE"


WEIGHTS = {"tech": weight(0.30, 0.35, 0.32), "aesthetic": weight(0.20, 0.40, 0.30), "composition": weight(0.15, 0.25, 0.20), "face": weight(0.35, 0.0, 0.18)}


def bonus(sharp: str, source: str) -> str:
    quality = f"(0.3::DOUBLE * {clamp('area / 0.05')} + 0.2::DOUBLE * {clamp(sharp)} + 0.4::DOUBLE * {clamp('eye')} + coalesce(0.1::DOUBLE * {clamp('smile')}, 0)) / (0.9::DOUBLE + CASE WHEN smile IS NULL THEN 0 ELSE 0.1::DOUBLE END)"
    # Least and greatest skip nulls, so a missing smile is told by the column itself.
    quality = quality.replace(f"coalesce(0.1::DOUBLE * {clamp('smile')}, 0)", f"CASE WHEN smile IS NULL THEN 0 ELSE 0.1::DOUBLE * {clamp('smile')} END")
    return f"""bonus AS MATERIALIZED (SELECT photo_id, {clamp("avg(q) * CASE WHEN count(*) FILTER (eye >= 0.3) >= ceil(count(*) * 0.8::DOUBLE) THEN 1 ELSE count(*) FILTER (eye >= 0.3) / count(*) END")} AS face_bonus
    FROM (SELECT photo_id, eye, {quality} AS q FROM {source}) GROUP BY photo_id)"""


MEMBERS = """members AS MATERIALIZED (SELECT o_custkey AS group_id, o_custkey - o_custkey % 3 AS composition_id, o_orderkey AS photo_id, epoch_us(o_orderdate) AS us,
    CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 100)::DOUBLE / 100 END AS exposure, (o_orderkey * 7 % 100)::DOUBLE / 100 AS wb, o_totalprice / 1000 AS sharpness_raw, (o_orderkey * 13 % 100)::DOUBLE / 100 AS noise,
    CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey * 3 % 100)::DOUBLE / 100 END AS aesthetic, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey * 11 % 100)::DOUBLE / 100 END AS composition,
    o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.jpg' ELSE '.NEF' END AS name FROM orders)"""


def scored(group: str = "group_id", source: str = "members", as_: str = "scored") -> list[str]:
    """Steps of scores within groups; their names end in ``as_``."""
    s = lambda x, m, d: f"(1 / (1 + exp(-(({x}) - {m}) / greatest({d}, 1e-6))))::DOUBLE"
    own = bonus("CASE WHEN m2 >= 2 THEN " + s("sharp", "middle", "spread") + " ELSE 0.5 END", f"pooled_{as_}").replace("bonus AS", f"bonus_{as_} AS", 1)
    return [
        f"known_{as_} AS MATERIALIZED (SELECT {group}, photo_id, us, exposure, wb, noise, coalesce(aesthetic, 0.5) AS aesthetic, coalesce(composition, 0.5) AS composition, CASE WHEN count(*) OVER w = 1 THEN 0.5 ELSE {s('sharpness_raw', 'avg(sharpness_raw) OVER w', 'stddev_pop(sharpness_raw) OVER w')} END AS sharpness FROM {source} WHERE exposure IS NOT NULL WINDOW w AS (PARTITION BY {group}))",
        f"pooled_{as_} AS MATERIALIZED (SELECT f.*, count(*) OVER w AS m2, avg(sharp) OVER w AS middle, stddev_pop(sharp) OVER w AS spread FROM faces f JOIN known_{as_} k USING (photo_id) WINDOW w AS (PARTITION BY k.{group}))",
        own,
        f"tech_{as_} AS MATERIALIZED (SELECT *, {clamp('0.30::DOUBLE * exposure + 0.20::DOUBLE * wb + 0.35::DOUBLE * sharpness + 0.15::DOUBLE * noise')} AS tech FROM known_{as_})",
        f"{as_} AS MATERIALIZED (SELECT {group}, photo_id, us, {SCENE} AS scene, sharpness, tech, aesthetic, composition, coalesce(face_bonus, 0)::DOUBLE AS face_bonus, {clamp(' + '.join(f'{w} * ' + ('coalesce(face_bonus, 0)' if p == 'face' else p) for p, w in WEIGHTS.items()))} AS value FROM tech_{as_} JOIN per_photo USING (photo_id) LEFT JOIN bonus_{as_} USING (photo_id))",
    ]


def ranks(group: str, source: str, as_: str, k: int) -> str:
    return f"{as_} AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY {group} ORDER BY value DESC, us, photo_id))::INT AS rank, CASE WHEN rank <= {k} THEN 'kept' ELSE 'rejected' END AS verdict FROM {source})"


def auto(group: str, source: str, as_: str) -> str:
    return f"""ordered_{as_} AS (SELECT *, (row_number() OVER w)::INT AS rank, greatest(first_value(value) OVER w, 1e-6) AS best, lag(value) OVER w AS before FROM {source} WINDOW w AS (PARTITION BY {group} ORDER BY value DESC, us, photo_id)),
  {as_} AS MATERIALIZED (SELECT *, CASE WHEN rank <= 5 AND bool_and(before IS NULL OR value / best >= 0.92 AND (before - value) / best <= 0.05) OVER (PARTITION BY {group} ORDER BY rank) THEN 'kept' ELSE 'rejected' END AS verdict FROM ordered_{as_})"""


SCORES = [FACES, PER_PHOTO, MEMBERS, *scored()]
PICKS = [*SCORES, ranks("group_id", "scored", "picks", 3)]
COMPOSED = [*PICKS, "left_over AS (SELECT m.* FROM members m JOIN picks USING (photo_id) WHERE verdict = 'kept')", *scored("composition_id", "left_over", "again"), auto("composition_id", "again", "made")]
PLAN = """plan AS (SELECT m.photo_id, m.name, m.group_id, s.group_id IS NULL OR coalesce(p.verdict = 'kept', false) AS picked FROM members m LEFT JOIN picks p USING (photo_id) LEFT JOIN (SELECT DISTINCT group_id FROM picks) s ON s.group_id = m.group_id)"""

SIMPLE_HASH = "substr(sha256(text), 1, 32)"
CACHED = f"""cached AS MATERIALIZED (SELECT key AS content_key, CASE WHEN k % 3 = 0 THEN 3 ELSE 4 END AS schema_version, k % 5 <> 0 AND k % 7 <> 0 AS whole, k AS created_at FROM (SELECT {SIMPLE_HASH} AS key, min(doc_id) AS k FROM documents WHERE lang = 'en' GROUP BY key) WHERE key IS NOT NULL),
  probe AS MATERIALIZED (SELECT doc_id AS photo_id, {SIMPLE_HASH} AS key, c.content_key IS NULL OR NOT c.whole AS miss FROM documents LEFT JOIN cached c ON c.content_key = {SIMPLE_HASH} AND c.schema_version = 4)"""


def _pixels() -> dict[str, str]:
    wide = lambda v, w: f"CASE WHEN i % 3 = 0 THEN {v} WHEN i % 3 = 1 AND y BETWEEN 20 AND 44 AND x BETWEEN 20 + i % 9 AND 49 THEN {w} ELSE 128 END"
    px = f"""px AS MATERIALIZED (SELECT *, (299 * r + 587 * g + 114 * b) // 1000 AS l, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM (SELECT i, x, y, {wide('(x * 7 + y * 13 + i * 31) % 256', 160)} AS r, {wide('(x * 3 + y * 5 + i * 17) % 256', 112)} AS g, {wide('(x * 11 + y * 2 + i * 7) % 256', 128)} AS b
    FROM (SELECT s_suppkey::BIGINT AS i FROM supplier), range({WIDTH}) a(x), range({HEIGHT}) c(y)))"""
    n = WIDTH * HEIGHT
    sat = "CASE WHEN hi > 0 THEN (hi - lo)::DOUBLE / hi ELSE 0 END"
    rem = "((g - b)::DOUBLE / (hi - lo) - 6 * floor((g - b)::DOUBLE / (hi - lo) / 6))"
    sixth = f"CASE WHEN hi = r THEN {rem} WHEN hi = g THEN (b - r)::DOUBLE / (hi - lo) + 2 ELSE (r - g)::DOUBLE / (hi - lo) + 4 END"
    hue = f"""hued AS MATERIALIZED (SELECT i, {sat} AS s, CASE WHEN hi > lo THEN floor(6 * ({sixth}) + 1e-9)::BIGINT % 36 ELSE 0 END AS bin FROM px),
  bins AS (SELECT i, bin, sum(s) AS w FROM hued WHERE s > 0.1 GROUP BY ALL),
  entropy AS MATERIALIZED (SELECT i, CASE WHEN any_value(total) > 1 THEN -sum(w / total * ln(w / total)) ELSE 0 END AS e FROM (SELECT *, sum(w) OVER (PARTITION BY i) AS total FROM bins) GROUP BY i)"""
    out = {}
    out["exposure_px"] = chain(px, "h AS (SELECT i, l, count(*) AS c FROM px GROUP BY ALL)", then=f"""SELECT i AS photo_id, round({clamp(f"0.4::DOUBLE * {clamp(f'-sum(c / {n} * log2(c / {n})) / 8')} + 0.3::DOUBLE * (1 - least(coalesce(sum(c) FILTER (l >= 250), 0) / {n} / 0.01, 1)) + 0.2::DOUBLE * (1 - least(coalesce(sum(c) FILTER (l <= 5), 0) / {n} / 0.05, 1)) + 0.1::DOUBLE * coalesce(sum(c) FILTER (l BETWEEN 64 AND 192), 0) / {n} - CASE WHEN i % 4 > 1.5 THEN 0.1::DOUBLE ELSE 0 END")}, 9) AS exposure FROM h GROUP BY i""")
    out["wb_px"] = chain(px, hue, "m AS (SELECT i, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px GROUP BY i)", then=f"""SELECT i AS photo_id, round(CASE WHEN g < 1 THEN 0.5 ELSE {clamp("raw + (1 - raw) * least(coalesce(e, 0) / ln(36), 1)")} END, 9) AS wb FROM (SELECT m.i, g, e, exp(-greatest(abs(r - g), abs(b - g)) / g / 0.15) AS raw FROM m LEFT JOIN entropy USING (i))""")
    out["noise_px"] = chain(px, "v AS (SELECT i, var_pop(l) AS v FROM px GROUP BY i, x // 8, y // 8)", f"k AS (SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY v) AS k FROM v)", then=f"""SELECT i AS photo_id, round(least(greatest(sqrt(greatest(100 * (i % 5), 50) / 100), 0.5) / greatest(sqrt(avg(v)), 0.5), 1.0)::DOUBLE, 9) AS noise FROM k WHERE k <= {max(n // 64 // 20, 1)} GROUP BY i""")
    out["aesthetic_px"] = chain(px, hue, f"a AS (SELECT i, l, row_number() OVER (PARTITION BY i ORDER BY l) - 1 AS k FROM px)", f"t AS (SELECT i, (max(l) FILTER (k = {n * 95 // 100}) - max(l) FILTER (k = {n * 5 // 100})) / 200 AS span FROM a GROUP BY i)",
        "s AS (SELECT i, s, row_number() OVER (PARTITION BY i ORDER BY s) - 1 AS k FROM hued)", f"u AS (SELECT i, avg(s) AS vivid FROM s WHERE k >= {n // 2} GROUP BY i)",
        then=f"SELECT t.i AS photo_id, round({clamp(f'0.45::DOUBLE * {clamp("span")} + 0.30::DOUBLE * least(coalesce(e, 0) / 3.58, 1) + 0.25::DOUBLE * vivid')}, 9) AS aesthetic FROM t JOIN u USING (i) LEFT JOIN entropy USING (i)")
    at = "l AS c, coalesce(lag(l) OVER h, l) AS a, coalesce(lead(l) OVER h, l) AS b, coalesce(lag(l) OVER v, l) AS u, coalesce(lead(l) OVER v, l) AS d"
    win = "WINDOW h AS (PARTITION BY i, y ORDER BY x), v AS (PARTITION BY i, x ORDER BY y)"
    mx, my = WIDTH // 30 + 1, HEIGHT // 30 + 1
    box = f"""avg(x) / {WIDTH} AS cx, avg(y) / {HEIGHT} AS cy, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) / {WIDTH * HEIGHT} AS area, ((min(y) < {my})::INT + (max(y) + {my} >= {HEIGHT})::INT + (min(x) < {mx})::INT + (max(x) + {mx} >= {WIDTH})::INT) / 4 AS near"""
    away = "least(" + ", ".join(f"sqrt((cx - {p} / 3) ** 2 + (cy - {q} / 3) ** 2)" for p in (1, 2) for q in (1, 2)) + ")"
    out["composition_px"] = chain(
        px, f"e AS MATERIALIZED (SELECT i, x, y, abs(4 * c - a - b - u - d) AS v FROM (SELECT i, x, y, {at} FROM px {win}))", "top AS MATERIALIZED (SELECT i, max(v) AS most FROM e GROUP BY i)",
        "colour AS MATERIALIZED (SELECT i, x, y, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) * 255 // hi END AS s, max(CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) * 255 // hi END) OVER (PARTITION BY i) AS best FROM px)",
        f"subject AS (SELECT i, {box} FROM e JOIN top USING (i) WHERE most >= 8 AND v >= greatest(most // 3, 4) GROUP BY i UNION ALL SELECT i, {box} FROM colour JOIN top USING (i) WHERE most < 8 AND best >= 40 AND s >= greatest(best * 60 // 100, 30) GROUP BY i HAVING count(*) >= 4)",
        then=f"SELECT s_suppkey::BIGINT AS photo_id, round(coalesce({clamp(f'0.5::DOUBLE * exp(-{away} / 0.15) + 0.3::DOUBLE * exp(-((area - 0.25) ** 2) / 0.045) + 0.2::DOUBLE * (1 - near)')}, 0.5), 9) AS composition FROM supplier LEFT JOIN subject ON i = s_suppkey".replace("coalesce(least", "if(i IS NULL, 0.5, least").replace(", 0.5), 9)", "), 9)"),
    )
    out["sharpness_px"] = chain(
        px, "side AS (SELECT i, x, y, l, lag(l) OVER h AS a, lead(l) OVER h AS b FROM px WINDOW h AS (PARTITION BY i, y ORDER BY x))",
        "near AS (SELECT i, x, y, l, a, b, lag(l) OVER v AS ul, lag(a) OVER v AS ua, lag(b) OVER v AS ub, lead(l) OVER v AS dl, lead(a) OVER v AS da, lead(b) OVER v AS db FROM side WINDOW v AS (PARTITION BY i, x ORDER BY y))",
        "kernel AS MATERIALIZED (SELECT i, x, y, 4 * l - a - b - ul - dl AS lap, sqrt((ub + 2 * b + db - ua - 2 * a - da) ** 2 + (da + 2 * dl + db - ua - 2 * ul - ub) ** 2) AS grad FROM near)",
        "rois AS (SELECT i, x0, 0.6::DOUBLE * var_pop(lap) + 0.4::DOUBLE * avg(grad) AS s FROM kernel, (VALUES (0), (4), (8)) r(x0) WHERE x BETWEEN x0 + 1 AND x0 + 62 AND y BETWEEN 1 AND 62 GROUP BY ALL)",
        then="SELECT i AS photo_id, round(greatest(max(s), 0)::DOUBLE, 9) AS sharpness_raw FROM rois GROUP BY i",
    )
    return out


def all_sql() -> dict[str, str]:
    base = (PHOTOS, DELTA, CANDIDATES)
    subsec = "CASE WHEN event_id % 2 = 0 THEN lpad((event_id % 1000)::VARCHAR, 3, '0') WHEN event_id % 3 = 0 THEN 'none' ELSE (event_id % 12345)::VARCHAR END"
    name = "split_part(path, '/', 2)"
    answer = """chr(42) || '*Rank ' || (turn + 1) || ' (Image ' || (conv_id % 5 + 1) || ')**: ' || role || ' first' || chr(10) || 'Image #' || (conv_id % 5 + 2) || ' - Rank ' || (turn + 2) || ': *' || role || '*' || chr(10) || 'Rank 9 (Image ' || (conv_id % 5 + 1) || '): again' || chr(10) || '排名 ' || (turn + 3) || ' (Image ' || (conv_id % 5 + 3) || '): **' || role || '**' || chr(10) || 'Image ' || (conv_id % 5 + 4) || ' (第 ' || (turn + 4) || '): last'"""
    first = r"(?i)(?:rank|排名|第)\s*#?\s*(\d+)[^\n]{0,40}?image\s*#?\s*(\d+)[\s)*_]*[-:—–]\s*([^\n]+)"
    second = r"(?i)image\s*#?\s*(\d+)[^\n]{0,40}?(?:rank|排名|第)\s*#?\s*(\d+)[\s)*_]*[-:—–]\s*([^\n]+)"
    found = lambda p, image, rank, o: f"SELECT conv_id, turn, {o} AS o, unnest(range(len(regexp_extract_all(t, '{p}', 3)))) AS k, unnest(regexp_extract_all(t, '{p}', {image}))::INT AS image, unnest(regexp_extract_all(t, '{p}', {rank}))::INT AS rank, regexp_replace(unnest(regexp_extract_all(t, '{p}', 3)), '^[\\s*_]+|[\\s*_]+$', '', 'g') AS reason FROM a"
    q = {
        "adaptive_dt": chain(PHOTOS, DELTA, then="SELECT delta_s FROM delta"),
        "burst_candidates": chain(*base, then="SELECT a, b FROM candidates"),
        "burst_edges": chain(*base, FEATURES, edges(0.95), then="SELECT a, b FROM edges"),
        "hash_edges": chain(*base, then="SELECT a, b FROM candidates JOIN photos f ON f.photo_id = a JOIN photos g ON g.photo_id = b WHERE bit_count(xor(f.phash, g.phash)) <= 6"),
        "burst_groups": chain(*base, FEATURES, edges(0.95), groups(), then=BURSTS),
        "burst_groups_adaptive": chain(*base, FEATURES, edges(0.925), groups(), then=BURSTS),
        "burst_groups_forced": chain(*base, FEATURES, edges(0.95), FORCED, groups("every"), then=BURSTS),
        "burst_summary": chain(*base, FEATURES, edges(0.95), groups(), then="SELECT photos, count(*) AS bursts FROM (SELECT group_id, count(*) AS photos FROM grouped GROUP BY group_id) GROUP BY photos"),
        "threshold_bias": chain(FACES, PER_PHOTO, "s AS (SELECT avg((largest >= 0.05)::INT) AS share FROM per_photo)", "t AS (SELECT share, least(greatest((share - 0.5) * 0.05, -0.025), 0.025) AS bias FROM s)",
            then="SELECT round(share, 9) AS share, round(bias, 9) AS bias, round(least(greatest(0.95 + bias, 0.7), 0.99)::DOUBLE, 9) AS burst_similarity, round(least(greatest(0.93 + bias, 0.7), 0.99)::DOUBLE, 9) AS composition_similarity FROM t"),
        "scene_weights": chain(FACES, PER_PHOTO, then=f"SELECT photo_id, {SCENE} AS scene, {', '.join(f'round({w}, 9) AS w_{p}' for p, w in WEIGHTS.items())} FROM per_photo"),
        "face_bonus": chain(FACES, bonus("sharp", "faces"), then="SELECT o_orderkey AS photo_id, round(coalesce(face_bonus, 0)::DOUBLE, 9) AS face_bonus FROM orders LEFT JOIN bonus ON photo_id = o_orderkey"),
        "face_sharpness_norm": chain(*SCORES, then="SELECT group_id, photo_id, round(face_bonus, 9) AS face_bonus FROM scored"),
        "tech_score_z": chain(*SCORES, then="SELECT group_id, photo_id, round(sharpness, 9) AS sharpness, round(tech, 9) AS tech FROM scored"),
        "final_score": chain(*SCORES, then="SELECT group_id, photo_id, scene, round(tech, 9) AS tech, round(aesthetic, 9) AS aesthetic, round(composition, 9) AS composition, round(face_bonus, 9) AS face_bonus, round(value, 9) AS value FROM scored"),
        "topk_k1": chain(*PICKS, then="SELECT group_id, photo_id, rank, verdict, round(value, 9) AS value FROM picks"),
        "topk_k2_fixed": chain(FACES, PER_PHOTO, MEMBERS, *scored("composition_id"), ranks("composition_id", "scored", "picks", 2), then="SELECT composition_id, photo_id, rank, verdict FROM picks"),
        "auto_k2": chain(FACES, PER_PHOTO, MEMBERS, *scored("composition_id"), auto("composition_id", "scored", "picks"), then="SELECT composition_id, photo_id, rank, verdict FROM picks"),
        "composition_edges": chain(SURVIVORS, VECTORS, then="SELECT s.photo_id AS a, t.photo_id AS b FROM vectors s JOIN vectors t ON s.photo_id < t.photo_id WHERE array_inner_product(s.e, t.e) > 0.93"),
        "raw_embedding_pairs_030": "SELECT s.vec_id AS a, t.vec_id AS b FROM embeddings s JOIN embeddings t ON s.vec_id < t.vec_id WHERE list_inner_product(s.embedding::DOUBLE[], t.embedding::DOUBLE[]) > 0.30",
        "plan_keep_reject": chain(*PICKS, PLAN, then="SELECT photo_id, CASE WHEN picked THEN 'picked' ELSE 'rejected' END AS verdict, CASE WHEN picked THEN 'picked/group_' || format('{:08x}', group_id) || '/' ELSE 'rejected/' END || name AS dest FROM plan"),
        "plan_composed": chain(*COMPOSED, then="SELECT m.photo_id, CASE WHEN k.photo_id IS NULL THEN 'rejected' ELSE 'picked' END AS verdict, CASE WHEN k.photo_id IS NULL THEN 'rejected/' ELSE 'picked/comp_' || format('{:08x}', k.composition_id) || '/' END || name AS dest FROM members m LEFT JOIN (SELECT * FROM made WHERE verdict = 'kept') k USING (photo_id)"),
        "override_flip": chain(*PICKS, then="SELECT photo_id, (verdict = 'kept') <> (o_orderstatus = 'F') AS keep FROM picks JOIN orders ON o_orderkey = photo_id"),
        "report_counts": chain(*PICKS, PLAN, "n AS (SELECT count(*) FILTER (verdict = 'rejected') AS r FROM picks)", then="SELECT count(*) AS photo_count, count(DISTINCT group_id) AS burst_count, 0::BIGINT AS composition_count, count(*) FILTER (picked) AS picked_count, any_value(r) AS rejected_count FROM plan, n"),
        "report_counts_composed": chain(*COMPOSED, then="SELECT count(*) AS photo_count, count(DISTINCT m.group_id) AS burst_count, (SELECT count(DISTINCT composition_id) FROM made) AS composition_count, count(*) FILTER (verdict = 'kept') AS picked_count, count(*) FILTER (verdict IS DISTINCT FROM 'kept') AS rejected_count FROM members m LEFT JOIN made USING (photo_id)"),
        "report_nested": chain(*PICKS, then="""SELECT m.group_id, '{"id":' || m.group_id || ',"photos":[' || string_agg('{"photo_id":' || m.photo_id || ',"verdict":"' || coalesce(verdict, 'unscored') || '"' || CASE WHEN rank IS NULL THEN '' ELSE ',"rank":' || rank || ',"value":' || round(value, 9) END || '}', ',' ORDER BY coalesce(rank, 2147483647), m.photo_id) || ']}' AS report FROM members m LEFT JOIN picks USING (photo_id) GROUP BY m.group_id"""),
        "progress_snapshot": "SELECT user_id AS run_id, event_id AS seq, kind, event_type AS stage, value AS done FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'stage' WHEN event_id % 4 = 3 THEN 'finish' ELSE 'tick' END AS kind FROM events) QUALIFY kind <> 'tick' OR row_number() OVER (PARTITION BY user_id, kind, event_type ORDER BY event_id DESC) = 1",
        "export_names": "SELECT o_orderkey AS photo_id, 'img' || o_custkey || '.jpg' AS name, 'img' || o_custkey || CASE WHEN row_number() OVER w = 1 THEN '' ELSE ' (' || row_number() OVER w || ')' END || '.jpg' AS exported FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
        "content_dedupe": f"SELECT {SIMPLE_HASH} AS content_key, count(*) AS copies, min(doc_id) AS first_photo_id FROM documents GROUP BY content_key",
        "cache_probe": chain(CACHED, then="SELECT photo_id, miss FROM probe"),
        "cache_upsert": chain(CACHED, "fresh AS (SELECT key, max(photo_id) + 1000000 AS created_at FROM probe WHERE miss AND key IS NOT NULL GROUP BY key)", then="SELECT content_key, schema_version::BIGINT AS schema_version, created_at FROM cached ANTI JOIN fresh ON key = content_key UNION ALL SELECT key, 4, created_at FROM fresh"),
        "ext_classify": chain("""p AS (SELECT doc_id, 'a.b/' || doc_id || ['.jpg', '.JPEG', '.nef', '.CR3', '.txt', '', '.jpe', '.tiff', '.Dng', '.heic', '.RAF', '.jpg.bak'][doc_id % 12 + 1] AS path FROM documents)""", f"e AS (SELECT doc_id, {name} AS name, CASE WHEN contains({name}, '.') THEN lower(split_part({name}, '.', -1)) ELSE '' END AS extension FROM p)",
            then="SELECT doc_id, name, extension, CASE WHEN extension IN ('jpg', 'jpeg', 'jpe') THEN 'jpeg' WHEN extension IN ('nef', 'cr3', 'dng', 'raf') THEN 'raw' END AS format, CASE WHEN extension IN ('nef', 'cr3', 'dng', 'raf') THEN extension END AS raw_kind FROM e"),
        "exif_subsec": f"SELECT event_id, coalesce(substr(rpad(TRY_CAST({subsec} AS BIGINT)::VARCHAR, 3, '0'), 1, 3)::INT, 0) AS ms, CASE WHEN {subsec} = 'none' THEN 0 ELSE substr(rpad({subsec}, 3, '0'), 1, 3)::INT END AS exact_ms FROM events",
        "html_escape": "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages",
        "rank_parse": chain(f"a AS (SELECT conv_id, turn, {answer} AS t FROM conversations)", f"f AS ({found(first, 2, 1, 0)} UNION ALL {found(second, 1, 2, 1)})", then="SELECT conv_id, turn, image, rank, reason FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, turn, image ORDER BY o, k) = 1"),
    }
    return q | _pixels()
