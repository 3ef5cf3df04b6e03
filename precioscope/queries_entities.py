"""Queries of entity resolution over titles that vary word by word, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from precioscope.functions import text as X
from precioscope.operators import entities as E
from precioscope.operators import resolve as R
from precioscope.queries import NORMAL, TOKENS, query, table


def titles(spark, sf_dir):
    """A listing for each part: words that neighbours share, a model for a fifth, a size for a third, a code for an eleventh."""
    p = F.col("p_partkey")
    word = lambda k: F.translate(F.substring(F.md5(F.floor(p / k).cast("string")), 1, 6), "0123456789", "ghijklmnop")
    name = F.concat_ws(" ", "p_name", word(3), word(7), word(13), word(4), F.when(p % 5 == 0, F.concat(F.lit("zx"), (1000 + F.floor(p / 15)).cast("string"))), F.when(p % 3 == 0, F.concat((8 * (1 + p % 2)).cast("string"), F.lit("gb"))))
    gtin = F.when(p % 11 == 0, (F.lit(7891000000) + F.floor(p / 33)).cast("string"))
    return table(spark, sf_dir, "part").select(p.alias("listing_id"), name.alias("name"), F.when(p % 17 != 0, 50.0 + p * 37 % 400).alias("price"), gtin.alias("gtin"))


_WORD = lambda k: f"translate(substr(md5((p_partkey // {k})::VARCHAR), 1, 6), '0123456789', 'ghijklmnop')"
_ALIKE = "(0.45::DOUBLE * (c / (n + m - c)) + 0.55::DOUBLE * (c / least(n, m)))"
_NEAR = "(x.price IS NULL OR y.price IS NULL OR abs(x.price - y.price) / greatest(x.price, y.price) <= 0.35::DOUBLE)"
_LISTINGS = f"""l AS MATERIALIZED (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'zx' || (1000 + p_partkey // 15) END AS model, CASE WHEN p_partkey % 3 = 0 THEN (8 * (1 + p_partkey % 2)) || 'gb' END AS spec,
    CASE WHEN p_partkey % 11 = 0 THEN 7891000000 + p_partkey // 33 END AS gtin, CASE WHEN p_partkey % 17 <> 0 THEN 50.0::DOUBLE + p_partkey * 37 % 400 END AS price,
    list_sort(list_distinct(list_filter(string_split(concat_ws(' ', p_name, {_WORD(3)}, {_WORD(7)}, {_WORD(13)}, {_WORD(4)}, CASE WHEN p_partkey % 5 = 0 THEN 'zx' || (1000 + p_partkey // 15) END, CASE WHEN p_partkey % 3 = 0 THEN (8 * (1 + p_partkey % 2)) || 'gb' END), ' '), lambda w: length(w) > 1))) AS words FROM part),
    t AS MATERIALIZED (SELECT id, unnest(words) AS w FROM l),
    o AS MATERIALIZED (SELECT a.id AS a, b.id AS b, count(*) AS c FROM t a JOIN t b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
    v AS (SELECT a, b, {_ALIKE} AS s, x.gtin AS gx, y.gtin AS gy, x.model AS mx, y.model AS my, x.spec AS sx, y.spec AS sy, {_NEAR} AS near FROM (SELECT o.*, len(x.words) AS n, len(y.words) AS m, x, y FROM o JOIN l x ON x.id = a JOIN l y ON y.id = b)),
    e AS MATERIALIZED (SELECT a, b FROM v WHERE CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN gx = gy
        WHEN gx IS NULL AND gy IS NULL AND mx IS NOT NULL AND my IS NOT NULL THEN (mx = my AND sx IS NOT DISTINCT FROM sy) OR s >= 0.88::DOUBLE OR (mx = my AND s >= 0.5::DOUBLE AND coalesce(sx = sy, true) AND near)
        ELSE coalesce(sx = sy, true) AND s >= 0.7::DOUBLE AND near END
        UNION SELECT x.id, y.id FROM l x JOIN l y ON x.gtin = y.gtin AND x.id < y.id)"""
_COMPONENTS = """, d AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT id, id FROM l),
    k AS (SELECT id AS a, id AS label, 0 AS step FROM l UNION ALL SELECT d.b, min(k.label), max(k.step) + 1 FROM k JOIN d ON d.a = k.a WHERE k.step < 40 GROUP BY d.b)"""


@query("resolved_entities", f"WITH RECURSIVE {_LISTINGS}{_COMPONENTS} SELECT a AS listing_id, min(label) AS product_id FROM k GROUP BY a")
def resolved_entities(spark, sf_dir):
    return E.resolve_entities(titles(spark, sf_dir)).select("listing_id", "product_id")


@query("resolution_agreement", "WITH g AS (SELECT 'q' || (p_partkey // 4 % 50) AS query_id, p_partkey // 4 AS m, p_partkey % 4 = 1 AS inverse, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT query_id, sum(n * (n - 1) / 2)::BIGINT AS pairs FROM g GROUP BY query_id) SELECT query_id, pairs AS left_pairs, pairs AS right_pairs, pairs AS both_pairs FROM s")
def resolution_agreement(spark, sf_dir):
    """Pairs that the greedy mode and the components put together, by query."""
    from precioscope.queries_web import _named

    n = F.col("p_partkey")
    listings = _named(spark, sf_dir).select(F.concat(F.lit("q"), (F.floor(n / 4) % 50).cast("string")).alias("query_id"), n.alias("listing_id"), "name", F.col("p_retailprice").alias("price"), (100 - F.col("p_size")).alias("score"), n.alias("ordinal"), F.lit(False).alias("specific"))
    return E.agreement(R.assign_products(listings, 1 << 30), E.resolve_entities(listings), "query_id")


ALIKE = f"""v AS (SELECT item_id * 4 + j AS node, list_distinct(CASE j WHEN 0 THEN t WHEN 1 THEN list_filter(t, lambda w: NOT contains(w, 'a')) WHEN 2 THEN list_filter(t, lambda w: length(w) <= 6) ELSE list_filter(t, lambda w: length(w) <> 5) || [CAST(item_id AS VARCHAR) || 'gb'] END) AS words FROM (SELECT item_id, {TOKENS} AS t FROM (SELECT item_id, {NORMAL} AS n FROM (SELECT item_id, text FROM benchmark))), (SELECT unnest([0, 1, 2, 3]) AS j)),
    k AS (SELECT node, unnest(words) AS w FROM v), c AS (SELECT a.node AS a, b.node AS b, count(*) AS c FROM k a JOIN k b USING (w) WHERE a.node < b.node GROUP BY ALL),
    s AS (SELECT c.a, c.b, 0.45::DOUBLE * (c / (len(x.words) + len(y.words) - c)) + 0.55::DOUBLE * (c / least(len(x.words), len(y.words))) AS similarity FROM c JOIN v x ON x.node = c.a JOIN v y ON y.node = c.b)"""


@query("alike_titles", f"WITH {ALIKE} SELECT theta, a, b, similarity FROM s, (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.82::DOUBLE]) AS theta) WHERE similarity >= theta")
def alike_titles(spark, sf_dir):
    """Pairs at the scores that the rules ask for; each text and three thinned ones are titles."""
    t = table(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("t"))
    thin = [F.col("t"), F.filter("t", lambda w: ~F.contains(w, F.lit("a"))), F.filter("t", lambda w: F.length(w) <= 6), F.concat(F.filter("t", lambda w: F.length(w) != 5), F.array(F.concat(F.col("item_id").cast("string"), F.lit("gb"))))]
    sets = t.select("item_id", F.posexplode(F.array(*map(F.array_distinct, thin))).alias("j", "words")).select((F.col("item_id") * 4 + F.col("j")).alias("node"), "words")
    left, right = sets.select(F.col("node").alias("a"), F.col("words").alias("x")), sets.select(F.col("node").alias("b"), F.col("words").alias("y"))
    out = None
    for theta in (0.5, 0.7, 0.82):
        scored = E.similar_pairs(sets, theta).join(left, "a").join(right, "b").select(F.lit(theta).alias("theta"), "a", "b", X.similarity(F.col("x"), F.col("y")).alias("similarity"))
        out = scored.filter(F.col("similarity") >= theta) if out is None else out.unionByName(scored.filter(F.col("similarity") >= theta))
    return out
