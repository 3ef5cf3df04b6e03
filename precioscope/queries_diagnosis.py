"""Queries of store diagnosis and sitemaps, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from precioscope.operators import diagnosis as D
from precioscope.operators import sitemaps as Z
from precioscope.queries import query, table

STORES = """s AS (SELECT s_suppkey AS k, 'loja' || s_suppkey || '.com.br' AS h, 'https://' || CASE WHEN s_suppkey % 2 = 0 THEN 'www.' ELSE '' END || 'loja' || s_suppkey || '.com.br' AS o FROM supplier)"""


def _stores(spark, sf_dir):
    k = F.col("s_suppkey")
    host = F.concat(F.lit("loja"), k.cast("string"), F.lit(".com.br"))
    return table(spark, sf_dir, "supplier").select(k.alias("store_id"), host.alias("host"), F.concat(F.lit("https://"), F.when(k % 2 == 0, "www.").otherwise(""), host).alias("origin"))


@query(
    "search_patterns",
    rf"""WITH {STORES}, u AS (SELECT *, CASE WHEN k % 11 = 0 THEN o || '/achar?x={{t}}' WHEN k % 13 = 0 THEN o || '/busca?q={{t}}' END AS told, CASE WHEN k % 3 = 0 THEN o || CASE WHEN k % 4 = 0 THEN '/catalogo/{{t}}' ELSE '/s?k={{t}}' END END AS known,
      CASE WHEN k % 17 = 0 THEN [] ELSE CASE WHEN k % 5 IN (0, 1) THEN [o || '/procurar?loja=1&field-keywords={{t}}&cat%20id=a%26b'] ELSE [] END || CASE WHEN k % 5 IN (1, 2) THEN [o || '/?w={{t}}'] ELSE [] END || CASE WHEN k % 7 = 0 THEN ['https://busca.loja.com/x?q={{t}}', 'https://busca.loja.com/x?nome={{t}}'] ELSE [] END END AS forms FROM s),
    l AS (SELECT *, list_filter([told, known] || forms || list_transform(['/busca?q=', '/busca/', '/search?q=', '/s?k=', '/?s=', '/pesquisa?t=', '/busca?termo=', '/catalogsearch/result/?q='], lambda p: o || p || '{{t}}') || [o || '/{{t}}?map=ft', o || '/search/?q={{t}}'], lambda x: x IS NOT NULL) AS every FROM u),
    d AS (SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i)[1:10] AS kept FROM l), e AS (SELECT *, unnest(kept) AS pattern, generate_subscripts(kept, 1) AS ordinal FROM d)
    SELECT k AS store_id, ordinal, pattern, CASE WHEN pattern = told THEN 'told' WHEN pattern = known THEN 'library' WHEN list_contains(forms, pattern) THEN 'form' ELSE 'usual' END AS source, ordinal <= len(forms) + CASE WHEN known IS NULL THEN 1 ELSE 2 END AS worth_browser, replace(pattern, '{{t}}', 'fog%C3%A3o%204%20bocas') AS address FROM e""",
)
def search_patterns(spark, sf_dir):
    s, k = _stores(spark, sf_dir), F.col("store_id")
    told = F.when(k % 11 == 0, F.concat("origin", F.lit("/achar?x={t}"))).when(k % 13 == 0, F.concat("origin", F.lit("/busca?q={t}")))
    parts = [
        ((k % 5).isin(0, 1), '<form action="/procurar?loja=1" method="GET"><input type=hidden name="cat id" value="a&amp;b"><p><input name="field-keywords"></form>'),
        ((k % 5).isin(1, 2), '<FORM><div><input type="search" name="w"></div><input type="hidden" name="e" value=""></FORM>'),
        (k % 5 == 3, '<form method="post" action="/q"><input name="q"></form><form action="#"><input name="q"></form><form><input placeholder="busca"></form>'),
        (k % 7 == 0, '<form action="https://busca.loja.com/x"><input name="q"><input name="nome" placeholder="Pesquisar"><input name="cor"></form>'),
    ]
    html = F.concat(F.lit("<html><body>"), *[F.when(c, t).otherwise("") for c, t in parts])
    stores = s.select("store_id", "origin", F.when(k % 17 != 0, html).alias("html"), told.alias("told"))
    known = s.filter(k % 3 == 0)
    host = F.when(k % 2 == 0, F.col("host")).otherwise(F.concat(F.lit("WWW."), F.col("host")))
    library = known.select(k.alias("ordinal"), host.alias("host"), F.concat("origin", F.when(k % 4 == 0, "/catalogo/{q}").otherwise("/s?k={q}")).alias("search_url"))
    library = library.unionByName(known.select((k + 1_000_000_000_000).alias("ordinal"), "host", F.lit("https://outra.com/{q}").alias("search_url"))).unionByName(s.select((-k).alias("ordinal"), "host", F.lit("").alias("search_url")))
    out = D.search_patterns(stores, library).join(s.select("store_id", "origin"), "store_id")
    return out.select("store_id", "ordinal", "pattern", "source", "worth_browser", D.search_address(F.col("pattern"), F.col("origin"), F.lit("fogão 4 bocas")).alias("address"))


TRIALS = """i AS (SELECT l_suppkey AS store_id, 1 + l_partkey % 10 AS ordinal, l_discount > 0.05 AS priced, l_tax > 0.02 AS linked, l_quantity > 48 AS coded, l_orderkey FROM lineitem),
    g AS (SELECT store_id, ordinal, 'p' || ordinal AS pattern, ['jsonld', 'blocks', 'state', 'microdata', 'selectors'][1 + (store_id * 3 + ordinal) % 5] AS strategy, count(*) AS items, count(*) FILTER (priced) AS priced, count(*) FILTER (priced AND linked) AS linked, count(*) FILTER (priced AND coded) AS with_code, count(*) FILTER (l_orderkey % 10 < (store_id * ordinal) % 11) / count(*) AS relevance FROM i GROUP BY ALL),
    t AS (SELECT *, (store_id + 2 * ordinal) % 9 = 0 AS home, store_id % 8 <> 0 AND (store_id * ordinal) % 7 <> 0 AS answered, CASE WHEN store_id % 8 = 0 THEN store_id % 16 = 0 ELSE (store_id + ordinal) % 6 = 0 END AS blocked, strategy IN ('jsonld', 'microdata') AS structured FROM g),
    p AS (SELECT *, CASE WHEN home THEN 0.0::DOUBLE ELSE CASE WHEN linked > 0 THEN linked ELSE priced END * relevance * CASE strategy WHEN 'jsonld' THEN 1.6::DOUBLE WHEN 'microdata' THEN 1.4::DOUBLE WHEN 'selectors' THEN 1.2::DOUBLE WHEN 'state' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END END AS points, answered AND NOT blocked AND NOT home AND relevance >= 0.2::DOUBLE AS usable FROM t),
    m AS (SELECT * FROM p QUALIFY coalesce(ordinal <= min(ordinal) FILTER (usable AND (ordinal >= 8 OR (priced >= 8 AND structured AND relevance > 0.6::DOUBLE))) OVER (PARTITION BY store_id), true))"""


@query(
    "diagnosed_trials",
    f"""WITH {TRIALS}, n AS (SELECT store_id, count(*) AS trials, count(*) FILTER (blocked) AS refused FROM m GROUP BY store_id), b AS (SELECT *, store_id % 5 = 0 AS forbidden, strategy IN ('jsonld', 'microdata', 'state') AS rich FROM m WHERE usable QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY points DESC, ordinal) = 1)
    SELECT n.store_id, pattern, coalesce(points, 0.0::DOUBLE) AS points, CASE WHEN points IS NULL OR points <= 0 THEN 'incompatible' WHEN priced >= 3 AND rich AND NOT forbidden THEN 'compatible' ELSE 'partial' END AS verdict, trials,
    CASE WHEN points IS NULL THEN CASE WHEN refused > 0 THEN 'search_blocked' ELSE 'search_not_found' END ELSE array_to_string(list_filter([CASE WHEN NOT rich THEN 'no_structured_data' END, CASE WHEN with_code = 0 THEN 'no_product_codes' END, CASE WHEN priced < items * 0.6::DOUBLE THEN 'few_prices' END, CASE WHEN forbidden THEN 'robots' END, CASE WHEN strategy = 'blocks' THEN 'layout_only' END], lambda x: x IS NOT NULL), ',') END AS limits FROM n LEFT JOIN b USING (store_id)""",
)
def diagnosed_trials(spark, sf_dir):
    priced, k, o = F.col("l_discount") > 0.05, F.col("store_id"), F.col("ordinal")
    i = table(spark, sf_dir, "lineitem").withColumns({"store_id": F.col("l_suppkey"), "ordinal": 1 + F.col("l_partkey") % 10})
    hit = F.col("l_orderkey") % 10 < (k * o) % 11
    t = i.groupBy("store_id", "ordinal").agg(F.count(F.lit(1)).alias("items"), F.count_if(priced).alias("priced"), F.count_if(priced & (F.col("l_tax") > 0.02)).alias("linked"), F.count_if(priced & (F.col("l_quantity") > 48)).alias("with_code"), (F.count_if(hit) / F.count(F.lit(1))).alias("relevance"))
    names = F.array(*map(F.lit, ("jsonld", "blocks", "state", "microdata", "selectors")))
    t = t.withColumns({"pattern": F.concat(F.lit("p"), o.cast("string")), "strategy": F.get(names, ((k * 3 + o) % 5).cast("int")), "home": (k + 2 * o) % 9 == 0, "answered": (k % 8 != 0) & ((k * o) % 7 != 0), "blocked": F.when(k % 8 == 0, k % 16 == 0).otherwise((k + o) % 6 == 0)})
    t = t.withColumn("structured", F.col("strategy").isin("jsonld", "microdata"))
    return D.diagnose_trials(t, t.select("store_id").filter("store_id % 5 = 0").distinct())


@query(
    "store_sitemaps",
    f"""WITH {STORES}, n AS (SELECT unnest(range(1, 11)) AS i),
    e AS (SELECT k, 0 AS place, 0 AS child, i - 1 AS pos, o || '/p/' || i AS url FROM s, n WHERE k % 4 <> 0 AND k % 3 <> 0 AND i <= k % 5
      UNION ALL SELECT k, 1, 0, i - 1, o || '/q/' || i FROM s, n WHERE k % 2 = 1 AND i <= k % 6
      UNION ALL SELECT k, 1, c.i - 1, n.i - 1, o || '/c' || c.i || '/' || n.i FROM s, n AS c, n WHERE k % 2 = 0 AND c.i <= least(5, k % 8) AND (k + c.i) % 3 <> 0 AND n.i <= c.i % 4
      UNION ALL SELECT k, 2, 0, 0, o || '/last' FROM s)
    SELECT k AS store_id, place, child * 4294967296 + pos AS ordinal, url FROM e QUALIFY place = min(place) OVER (PARTITION BY k)""",
)
def store_sitemaps(spark, sf_dir):
    s, k, o = _stores(spark, sf_dir), F.col("store_id"), F.col("origin")
    count = F.sequence(F.lit(1), F.lit(10))

    def locs(n, path):
        return F.array_join(F.transform(F.slice(count, F.lit(1), n.cast("int")), lambda i: F.concat(F.lit("<url><loc> "), o, path(i.cast("string")), F.lit("\n</loc></url>"))), "")

    first = s.filter(k % 4 != 0).select(F.concat(o, F.lit("/sitemap.xml")).alias("url"), (k % 3 != 0).alias("ok"), F.concat(F.lit("<urlset>"), locs(k % 5, lambda i: F.concat(F.lit("/p/"), i))).alias("body"))
    index = F.concat(F.lit("<sitemapIndex>"), locs(k % 8, lambda i: F.concat(F.lit("/m"), i, F.lit(".xml"))))
    second = s.select(F.concat(o, F.lit("/sitemap_index.xml")).alias("url"), F.lit(True).alias("ok"), F.when(k % 2 == 0, index).otherwise(F.concat(F.lit("<urlset>"), locs(k % 6, lambda i: F.concat(F.lit("/q/"), i)))).alias("body"))
    third = s.select(F.concat(o, F.lit("/sitemap/sitemap.xml")).alias("url"), F.lit(True).alias("ok"), F.concat(F.lit("<urlset><loc>"), o, F.lit("/last</loc>")).alias("body"))
    child = s.withColumn("m", F.explode(count))
    name = F.col("m").cast("string")
    below = child.select(F.concat(o, F.lit("/m"), name, F.lit(".xml")).alias("url"), ((k + F.col("m")) % 3 != 0).alias("ok"), F.concat(F.lit("<urlset>"), locs(F.col("m") % 4, lambda i: F.concat(F.lit("/c"), name, F.lit("/"), i))).alias("body"))
    return Z.read_sitemaps(s.select("store_id", "origin"), first.unionByName(second).unionByName(third).unionByName(below))
