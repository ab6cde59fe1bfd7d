"""DuckDB SQL for the queries of the catalog, put together from common table expressions."""

from __future__ import annotations

CTE: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTE[name] = (body, needs)


def sql(body: str, *names: str) -> str:
    """WITH all the named expressions and what they need, then the body."""
    order: list[str] = []

    def add(n: str) -> None:
        if n not in order:
            for m in CTE[n][1]:
                add(m)
            order.append(n)

    for n in names:
        add(n)
    return ("WITH " + ("RECURSIVE " if any(f"FROM {n} " in CTE[n][0] for n in order) else "") + ",\n".join(f"{n} AS ({CTE[n][0]})" for n in order) + "\n" if order else "") + body


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def sqdist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def mixed(i: str, k: str, seed: int) -> str:
    """pairs.mixed of whole numbers from 0 on."""
    m = 2147483647
    t = f"((({i}) % {m} * 1103515 + ({k}) * 104729 + {seed * 7919 + 12345}) % {m})"
    t = f"(({t} * {t} + ({i}) % {m}) % {m})"
    t = f"(({t} * 48271 + 11) % {m})"
    return f"({t} * {t} % {m})"


cte("samples", "SELECT vec_id AS id, CASE WHEN label = 9 AND vec_id % 3 = 0 THEN -1 ELSE label END AS person, (vec_id % 2)::INT AS cam, vec_id % 10 = 0 AS is_query, embedding::DOUBLE[] AS x FROM embeddings")
cte("scores", f"SELECT p.id AS probe_id, p.person AS probe_person, p.cam AS probe_cam, g.id AS gallery_id, g.person AS gallery_person, g.cam AS gallery_cam, {dot('p.x', 'g.x')} AS score FROM samples p, samples g WHERE p.is_query AND NOT g.is_query", "samples")
cte("judged", "SELECT *, gallery_person = probe_person AND gallery_cam <> probe_cam AND gallery_person <> -1 AS good, (gallery_person = probe_person AND gallery_cam = probe_cam) OR gallery_person = -1 AS junk FROM scores", "scores")
cte("ranked", "SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, gallery_id) AS rk FROM judged WHERE NOT junk", "judged")
cte("ap", """SELECT probe_id, sum(CASE WHEN good THEN h / rk + CASE WHEN rk = 1 THEN 1.0 ELSE (h - 1) / (rk - 1) END END) / (2 * nullif(sum(good::INT), 0)) AS ap, min(CASE WHEN good THEN rk END) AS first_hit, sum(good::INT)::BIGINT AS n_good
 FROM (SELECT *, (sum(good::INT) OVER (PARTITION BY probe_id ORDER BY rk))::DOUBLE AS h FROM ranked) GROUP BY probe_id""", "ranked")
cte("pixels", """SELECT image_id, (p // 8)::INT AS row, (p % 8)::INT AS col, red, green, blue, CASE WHEN p % 8 IN (0, 7) THEN 0 ELSE [56, 79, 96, 110, 136][((p // 8) * 5) // 8 + 1] END AS mask FROM (
 SELECT id AS image_id, p, ch(x[p + 1]) AS red, ch(x[(p + 21) % 64 + 1]) AS green, ch(x[(p + 42) % 64 + 1]) AS blue FROM (SELECT id, x, unnest(range(0, 64)) AS p FROM samples))""".replace("ch(x[p + 1])", "least(255, greatest(0, floor((4 * x[p + 1] + 1) * 127.5)))::INT").replace("ch(x[(p + 21) % 64 + 1])", "least(255, greatest(0, floor((4 * x[(p + 21) % 64 + 1] + 1) * 127.5)))::INT").replace("ch(x[(p + 42) % 64 + 1])", "least(255, greatest(0, floor((4 * x[(p + 42) % 64 + 1] + 1) * 127.5)))::INT"), "samples")
cte("sp", "SELECT *, (row // 2) * 4 + col // 2 AS sp FROM pixels", "pixels")
cte("grey", "SELECT *, floor(0.2989::DOUBLE * red + 0.5870::DOUBLE * green + 0.1140::DOUBLE * blue + 0.5::DOUBLE)::INT AS gray FROM sp", "sp")
cte("slopes", """SELECT *, CASE WHEN lag(v) OVER c IS NULL THEN lead(v) OVER c - v WHEN lead(v) OVER c IS NULL THEN v - lag(v) OVER c ELSE lead(v) OVER c - lag(v) OVER c END AS iy,
 CASE WHEN lag(v) OVER r IS NULL THEN lead(v) OVER r - v WHEN lead(v) OVER r IS NULL THEN v - lag(v) OVER r ELSE lead(v) OVER r - lag(v) OVER r END AS ix
 FROM (SELECT *, sqrt(gray::DOUBLE) AS v FROM grey) WINDOW c AS (PARTITION BY image_id, row ORDER BY col), r AS (PARTITION BY image_id, col ORDER BY row)""", "grey")
cte("grads", "SELECT *, sqrt(ix * ix + iy * iy) AS magnitude, greatest(1, least(9, ceil(9 * CASE WHEN atan2(iy, ix) < 0 THEN atan2(iy, ix) + 2 * pi() ELSE atan2(iy, ix) END / (2 * pi()))))::INT AS bin FROM slopes", "slopes")
cte("hog", "SELECT image_id, sp, bin, sqrt(CASE WHEN s > 0 THEN n / s ELSE n END) AS v FROM (SELECT image_id, sp, bin - 1 AS bin, sum(magnitude) AS n, sum(sum(magnitude)) OVER (PARTITION BY image_id, sp) AS s FROM grads GROUP BY image_id, sp, bin)", "grads")
cte("bins9", "SELECT k.image_id, k.sp, list(coalesce(h.v, 0.0) ORDER BY k.b) AS feat FROM (SELECT * FROM (SELECT DISTINCT image_id, sp FROM hog), (SELECT unnest(range(0, 9)) AS b)) k LEFT JOIN hog h ON h.image_id = k.image_id AND h.sp = k.sp AND h.bin = k.b GROUP BY k.image_id, k.sp", "hog")
cte("words", "SELECT w AS word, list_transform(range(0, 9), lambda j: ((w * 7 + j * 3) % 11)::DOUBLE / 11.0) AS center FROM (SELECT unnest(range(0, 12)) AS w)")
cte("votes", f"SELECT image_id, sp, word::INT AS word, d AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id, sp ORDER BY d, word) AS rank FROM (SELECT image_id, sp, word, sqrt({sqdist('feat', 'center')}) AS d FROM bins9, words)) WHERE rank <= 3", "bins9", "words")
cte("strips", "SELECT image_id, sp, s::INT AS strip, 'mid' AS band FROM (SELECT image_id, sp, unnest(range(greatest(floor((c - 4 + 2) / 2), 0)::INT, floor(c / 2)::INT + 1)) AS s FROM (SELECT image_id, sp, avg(row) AS c FROM sp GROUP BY image_id, sp)) WHERE s < 3", "sp")
cte("tf", "SELECT image_id, word, count(*) AS tf FROM votes GROUP BY image_id, word", "votes")


def strip_hist(weight: str) -> str:
    return f"SELECT s.image_id, s.strip, v.word, sum({weight}) / sqrt(any_value(tf.tf)::DOUBLE) AS h FROM strips s JOIN votes v ON s.image_id = v.image_id AND s.sp = v.sp JOIN tf ON tf.image_id = v.image_id AND tf.word = v.word GROUP BY s.image_id, s.strip, v.word"


cte("hist_soft", strip_hist("exp(-distance / 9.0)"), "strips", "votes", "tf")
cte("pos", "SELECT a.id AS id_a, b.id AS id_b, a.person, a.x AS xa, b.x AS xb FROM samples a JOIN samples b ON a.person = b.person AND a.cam <> b.cam AND a.id < b.id", "samples")
cte("idx", "SELECT *, row_number() OVER (ORDER BY id) - 1 AS idx, count(*) OVER () AS n FROM samples", "samples")
cte("neg", """SELECT a.id AS id_a, b.id AS id_b, k AS draw, a.x AS xa, b.x AS xb FROM (SELECT *, unnest(range(0, 5)) AS k FROM idx) a JOIN idx b ON b.idx = """ + mixed("a.idx", "k", 17) + """ % a.n WHERE a.person <> b.person AND a.cam <> b.cam""", "idx")
cte("n", "SELECT count(*) AS n FROM samples", "samples")
cte("drawn", f"""SELECT min(d) AS d, id_a, id_b FROM (SELECT d, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM (SELECT d, {mixed("d", "1", 3)} % n AS ia, {mixed("d", "2", 11)} % n AS ib FROM n, (SELECT unnest(range(0, (SELECT 8 * count(*) + 4096 FROM pos))) AS d)) JOIN idx a ON a.idx = ia JOIN idx b ON b.idx = ib WHERE a.person <> b.person AND a.cam <> b.cam) GROUP BY id_a, id_b""", "n", "idx", "pos")
cte("balanced", "SELECT id_a, id_b, true AS match FROM pos UNION ALL SELECT id_a, id_b, false FROM (SELECT *, row_number() OVER (ORDER BY d) AS r FROM drawn) WHERE r <= (SELECT count(*) FROM pos)", "pos", "drawn")
cte("scored", f"SELECT id_a * 1000003 + id_b AS key, match, sqrt({sqdist('a.x', 'b.x')}) AS distance FROM balanced JOIN samples a ON a.id = id_a JOIN samples b ON b.id = id_b", "balanced", "samples")
cte("matches", "SELECT t AS trial, a.pid AS probe, b.pid AS gallery, a.pid = b.pid AS match, a.x AS a, b.x AS b FROM (SELECT unnest([0, 1]) AS t) JOIN (SELECT id // 2 AS pid, x FROM samples WHERE cam = 0) a ON (a.pid + t) % 2 = 0 JOIN (SELECT id // 2 AS pid, x FROM samples WHERE cam = 1) b ON (b.pid + t) % 2 = 0", "samples")
cte("near", f"SELECT t.id AS test, t.person AS truth, g.id AS train, g.person AS label, {sqdist('t.x', 'g.x')} AS d, row_number() OVER (PARTITION BY t.id ORDER BY {sqdist('t.x', 'g.x')}, g.id) AS rk FROM samples t, samples g WHERE t.is_query AND NOT g.is_query", "samples")
cte("targets", f"SELECT i, j, d, rk FROM (SELECT a.id AS i, b.id AS j, {sqdist('a.x', 'b.x')} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {sqdist('a.x', 'b.x')}, b.id) AS rk FROM samples a JOIN samples b ON a.person = b.person AND a.id <> b.id) WHERE rk <= 3", "samples")
cte("imps", f"SELECT i, l, d FROM (SELECT a.id AS i, b.id AS l, {sqdist('a.x', 'b.x')} AS d, greatest(ma.margin, mb.margin) AS m FROM samples a JOIN samples b ON a.person <> b.person JOIN (SELECT i, max(d) + 0.05 AS margin FROM targets GROUP BY i) ma ON ma.i = a.id JOIN (SELECT i, max(d) + 0.05 AS margin FROM targets GROUP BY i) mb ON mb.i = b.id) WHERE d < m", "samples", "targets")
cte("centres", "SELECT k, list_transform(range(0, 64), lambda j: ((k * 5 + j * 3) % 13 - 6)::DOUBLE / 40.0) AS c FROM (SELECT unnest(range(0, 8)) AS k)")
cte("assigned", f"SELECT id, x, k AS cluster, d FROM (SELECT id, x, k, sqrt({sqdist('x', 'c')}) AS d, row_number() OVER (PARTITION BY id ORDER BY {sqdist('x', 'c')}, k) AS r FROM samples, centres) WHERE r = 1", "samples", "centres")


def inverse(name: str) -> None:
    """name_rows: the rows of the inverse of the positive definite matrix name(i, j, v), column by column without exchanging rows."""
    d = f"(SELECT count(DISTINCT i) FROM {name})"
    cte(f"{name}_wide", f"SELECT i, list_concat(list(v ORDER BY j), list_transform(range(0, {d}), lambda k: (k = any_value(i))::DOUBLE)) AS r FROM {name} GROUP BY i".replace("any_value(i)", "i"), name)
    step = "CASE WHEN a.i = a.k THEN list_transform(a.r, lambda v: v / a.r[a.k + 1]) ELSE list_transform(list_zip(a.r, b.r), lambda z: z[1] - z[2] * a.r[a.k + 1] / b.r[a.k + 1]) END"
    cte(f"{name}_steps", f"SELECT 0::BIGINT AS k, i, r FROM {name}_wide UNION ALL SELECT a.k + 1, a.i, {step} FROM {name}_steps a JOIN {name}_steps b ON b.i = a.k WHERE a.k < {d}", f"{name}_wide")
    cte(f"{name}_inverse", f"SELECT i::INT AS i, j::INT AS j, r[{d} + j + 1] AS v FROM (SELECT i, r, unnest(range(0, {d})) AS j FROM {name}_steps WHERE k = {d})", f"{name}_steps")


for _side in ("pos", "neg"):
    cte(f"{_side}_cov", f"SELECT i, j, avg((xa[i + 1] - xb[i + 1]) * (xa[j + 1] - xb[j + 1])) AS v FROM {_side}, (SELECT unnest(range(0, 64)) AS i), (SELECT unnest(range(0, 64)) AS j) GROUP BY i, j", _side)
    inverse(f"{_side}_cov")


def rounds(n: int, k: int) -> str:
    """Name of the table k, c of k centres after n Lloyd rounds from the first k samples."""
    cte("round_0", f"SELECT id AS k, x AS c FROM samples WHERE id < {k}", "samples")
    for t in range(n):
        near = f"SELECT x, k AS cluster FROM (SELECT x, k, row_number() OVER (PARTITION BY id ORDER BY {sqdist('x', 'c')}, k) AS r FROM samples, round_{t}) WHERE r = 1"
        cells = f"SELECT cluster AS k, i, avg(v) AS v FROM (SELECT cluster, unnest(x) AS v, unnest(range(0, 64)) AS i FROM ({near})) GROUP BY cluster, i"
        cte(f"round_{t + 1}", f"SELECT k, list(v ORDER BY i) AS c FROM ({cells}) GROUP BY k", f"round_{t}")
    return f"round_{n}"


def curve(hits: str, n: int | str) -> str:
    """rank, rate over the table expression hits(first_hit)."""
    return f"SELECT r AS rank, round((SELECT count(*) FROM {hits} WHERE first_hit <= r) / (SELECT count(*) FROM {hits}), 6) AS rate FROM (SELECT unnest(range(1, {n} + 1)) AS r)"
