"""Titles, prices, identity, pages: fixed expectations."""

import pytest
from pyspark.sql import functions as F

from precioscope.functions import extract as E
from precioscope.functions import policy as P
from precioscope.functions.dom import parse, select
from precioscope.functions.facets import FIELDS, apply_filters, attributes, label
from precioscope.functions.identity import compact, identify, same_in_query, similarity, tokens
from precioscope.functions.money import best_instalments, effective_price, read_price, with_coupon
from precioscope.functions.text import normalise, specs_normal, trusted_brand, within_one_edit
from precioscope.operators.interpret import interpret
from precioscope.operators.score import price_sanity, score


def test_interpretation(spark):
    texts = ["Apple", "cafeteira oster maxima", "RTX 5070 Gigabyte 12GB", "iPhone 17 Pro 256GB", "monitor aoc 27", "Aparelho 110V", "Aparelho 127 v", "", None]
    got = {r["text"]: r for r in interpret(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert not got["Apple"]["accepted"] and not got[""]["accepted"] and not got[None]["accepted"]
    oster = got["cafeteira oster maxima"]
    assert (oster["brand"], oster["category"]) == ("oster", "cafeteira") and "maxima" in oster["keywords"] and oster["specificity"] >= 55
    assert "rtx5070" in got["RTX 5070 Gigabyte 12GB"]["models"] and "12gb" in got["RTX 5070 Gigabyte 12GB"]["specs"]
    assert got["iPhone 17 Pro 256GB"]["brand"] == "apple" and "256gb" in got["iPhone 17 Pro 256GB"]["specs"]
    assert "aoc27" not in got["monitor aoc 27"]["models"]
    assert got["Aparelho 110V"]["specs"] == got["Aparelho 127 v"]["specs"] == ["127v"]


SCORED = [
    ("RTX 5070", "Placa de Vídeo RTX 5070 Ti 16GB", False),
    ("RTX 5070 Ti 16GB", "Placa de Vídeo RTX 5070 16GB", False),
    ("RTX 5070", "Placa de Vídeo MSI GeForce RTX 5070 12G VENTUS 2X OC", True),
    ("cafeteira oster maxima", "Cafeteira Oster Digital Flavor", False),
    ("cafeteira oster maxima", "Cafeteira Oster Expresso Maximma", True),
    ("ninja creami", "Ninja Creami Cookbook for Beginners", False),
    ("ninja creami", "Potes Ninja Creami 2 Unidades", False),
    ("notebook dell inspiron", "Notebook Dell Inspiron Usado, ótimo estado", False),
    ("notebook dell inspiron", "Notebook Dell Inspiron Seminovo", False),
    ("notebook 16gb", "Notebook Acer Aspire 12GB RAM SSD 256GB", False),
]


def test_scores(spark):
    rows = score(interpret(spark.createDataFrame(SCORED, "text string, name string, expected boolean"))).collect()
    assert [(r["name"], r["accepted"]) for r in rows if r["accepted"] != r["expected"]] == []
    assert all(r["eliminated"] for r in rows if "Usado" in r["name"] or "Seminovo" in r["name"] or "12GB RAM" in r["name"])


def test_price_sanity(spark):
    rows = [(1, p, 60, ["maxima"]) for p in (204.0, 1950.0, 2000.0, 2050.0)] + [(1, None, 60, ["maxima"])]
    got = price_sanity(spark.createDataFrame(rows, "query_id long, price double, specificity int, keywords array<string>"), "query_id")
    assert {r["price"] for r in got.filter("not kept").collect()} == {204.0}


@pytest.mark.parametrize(
    "specific,a,p,b,q,same",
    [
        (True, "Ninja Máquina de Sorvete Creami 110V", 2199, "Ninja, Sorveteira, Creami, 7 Programas Auto-iQ, 127 v", 2299, True),
        (False, "Ninja Máquina de Sorvete Creami 110V", 2199, "Ninja Máquina de Sorvete Creami 220V", 2199, False),
        (False, "Placa de Vídeo Gigabyte RTX 5070 EAGLE 12G", 4500, "Placa de Vídeo Gigabyte RTX 5070 AERO 12G", 4600, False),
        (False, "Placa de Vídeo Gigabyte RTX 5070 WINDFORCE OC 12G", 4500, "Gigabyte GeForce RTX 5070 WINDFORCE OC 12GB GDDR7", 4600, True),
        (False, "Notebook Acer Aspire Ryzen 5 8GB SSD 256GB", 2500, "Notebook Acer Aspire Celeron 8GB SSD 256GB", 2200, False),
        (False, "Cafeteira Expresso Oster Prima Latte", 800, "Cafeteira Expresso Philips Walita Daily", 750, False),
    ],
)
def test_same_product(specific, a, p, b, q, same):
    x, y = identify(a, p), identify(b, q)
    assert same_in_query(x, y, specific)[0] == same_in_query(y, x, specific)[0] == same


def test_text_properties():
    for s in ("Ação  Ótima 14” (nova)", "RTX-5070 Ti", "", "ß œ"):
        assert compact(compact(s)) == compact(s)
        assert similarity(set(tokens(s)), set(tokens("rtx ti"))) == similarity(set(tokens("rtx ti")), set(tokens(s)))


def test_column_text(spark):
    df = spark.createDataFrame([("Placa “14” polegadas, 1,5 L Açaí 110V",)], "t string")
    n = df.select(normalise(F.col("t")).alias("n"), specs_normal(normalise(F.col("t"))).alias("s"), within_one_edit(F.lit("expresso"), F.lit("espresso")).alias("e")).first()
    assert n["n"] == 'placa "14" polegadas, 1,5 l acai 110v' and n["s"] == ["14pol", "1.5l", "127v"] and n["e"]


@pytest.mark.parametrize(
    "name,brand,store,host,expected",
    [
        ("Placa de Vídeo Gigabyte RTX 5070 Eagle 12G", "FLER EQUIPAMENTOS E INTERMEDIACAO DE NEGOCIOS LTDA", None, None, "gigabyte"),
        ("Cafeteira sem marca reconhecida no título", "Não Informado", None, None, ""),
        ("Notebook 15 polegadas", "kabum!", "KaBuM!", "kabum.com.br", ""),
        ("Notebook 15 polegadas", "Dell", "KaBuM!", "kabum.com.br", "Dell"),
        ("MacBook Pro 14", "GoImports", "Goimports", "goimports.com.br", ""),
    ],
)
def test_trusted_brand(spark, name, brand, store, host, expected):
    row = spark.createDataFrame([(name, brand, store, host)], "n string, b string, s string, h string").select(trusted_brand(*map(F.col, "nbsh")).alias("x")).first()
    assert row["x"] == expected


TITLES = [
    ("Apple MacBook Air 13 Polegadas Processador M5 - 24gb Ram - 1tb Ssd - Estelar", "m5,24gb,1tb,13pol,estelar"),
    ("Notebook Asus Vivobook Go 15, AMD Ryzen 5, 8GB de Memória, Armazenamento 512GB SSD", "ryzen5,8gb,512gb"),
    ("Cafeteira Espresso Oster Perfect Brew Máxima 220v", "220v"),
    ("Placa de Vídeo Gigabyte RTX 5070 WINDFORCE OC SFF 12G, 12GB GDDR7", "12gb"),
    ("Apple 2025 MacBook Pro (de 14 polegadas, Chip M4 Pro, 24 GB, 512 GB SSD) - Preto-espacial", "m4,m4pro,24gb,512gb,14pol,preto espacial"),
    ("MacBook Air M4 16GB 256GB Prata 13 Polegadas A3113", "m4,16gb,256gb,13pol,prata,a3113"),
    ("MacBook Pro M4 Max 32GB 1TB SSD Cinza Espacial 14 Polegadas A2992", "m4,m4max,32gb,1tb,14pol,cinza espacial,a2992"),
    ("Notebook Dell Inspiron Intel Core i7 16GB RAM 512GB SSD 15.6 Polegadas Prata", "corei7,16gb,512gb,15.6pol,prata"),
    ("Notebook Lenovo IdeaPad AMD Ryzen 7 16 GB Memória 1TB HD Cinza", "ryzen7,16gb,1tb,cinza"),
    ("Liquidificador Philips Walita 1,5L 220V", "220v,1.5l"),
    ("Ferro de Passar Philco Bivolt", "bivolt"),
    ("MacBook Air M4 8GB 256GB Meia-noite 13 Polegadas", "m4,8gb,256gb,13pol,meia-noite"),
    ("Tênis Nike Air Max 42 Preto", "preto"),
    ("Fone de Ouvido JBL Bluetooth Preto", "preto"),
    ("Notebook Acer Aspire 14.5 Polegadas Intel Core i5 8GB 256GB SSD Prata", "corei5,8gb,256gb,14.5pol,prata"),
    ("Notebook Gamer XPTO SSD 512GB 16GB RAM Preto", "16gb,512gb,preto"),
    ("SSD Externo 2TB Preto", "2tb,preto"),
    ("Apple MacBook Air 13 Polegadas M4 16GB 512GB Azul", "m4,16gb,512gb,13pol,azul"),
]


def test_title_attributes(spark):
    df = spark.createDataFrame(TITLES, "t string, e string").select("t", "e", attributes(F.col("t")).alias("a"))
    bad = [r["t"] for r in df.collect() if sorted(filter(None, (r["a"][f] for f in FIELDS))) != sorted(r["e"].split(","))]
    assert bad == []
    assert apply_filters(df.select("t", "a.*"), {"processor": ["m4"], "memory": ["16gb"], "colour": []}).count() == 2
    shown = [("processor", "m4pro", "M4 Pro"), ("storage", "512gb", "512 GB"), ("screen", "13pol", "13 polegadas"), ("voltage", "127v", "127V"), ("capacity", "1.5l", "1.5 L"), ("colour", "meia-noite", "Meia-Noite")]
    got = spark.createDataFrame(shown, "f string, v string, e string").select("e", label(F.col("f"), F.col("v")).alias("x")).collect()
    assert [r["x"] for r in got] == [r["e"] for r in got]


def test_money(spark):
    prices = [("R$ 4.599,00", 4599.0), ("1.234", 1234.0), ("89,90", 89.9), ("x", None), ("0,00", None), (None, None)]
    df = spark.createDataFrame(prices, "t string, e double").select("t", "e", read_price(F.col("t")).alias("p"))
    assert [r["p"] for r in df.collect()] == [p for _, p in prices] == [E.read_price(t) for t, _ in prices]
    coupon = lambda k, v: F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"))
    row = spark.range(1).select(
        with_coupon(F.lit(100.0), F.lit("percent"), F.lit(10.0)).alias("a"),
        with_coupon(F.lit(100.0), F.lit("amount"), F.lit(30.0)).alias("b"),
        with_coupon(F.lit(20.0), F.lit("amount"), F.lit(500.0)).alias("c"),
        effective_price(F.lit(200.0), F.array(coupon("percent", 10.0)), F.lit(5.0)).alias("d"),
        best_instalments(F.lit("10x de R$ 50,00 sem juros ou 12x de R$ 45,00"), F.lit(500.0)).alias("e"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]["times"]) == (90.0, 70.0, 0.0, 171.0, 12)


@pytest.mark.parametrize(
    "html,coupons,cash",
    [
        ("<span>Cupom de 10% de desconto aplicado</span>", [("percent", 10.0, True)], None),
        ('<div title="10% de desconto no cupom">ver oferta</div>', [("percent", 10.0, False)], None),
        ("<span>Cupom de R$ 50</span>", [("amount", 50.0, False)], None),
        ("<div><span>Cupom</span><span>R$ 50 de desconto</span></div>", [("amount", 50.0, False)], None),
        ("<button>Aplicar cupom de 5%</button>", [("percent", 5.0, False)], None),
        ("<span>-10% com cupom</span>", [("percent", 10.0, False)], None),
        ("<span>10x de R$ 50,00 sem juros</span>", [], None),
        ("<span>5% off à vista no Pix</span>", [], {"percent": 5.0, "form": "pix"}),
        ("<span>5% de cashback</span>", [], None),
        ("<span>Frete grátis para todo o Brasil</span>", [], None),
    ],
)
def test_coupons(html, coupons, cash):
    root = parse(f"<div>{html}</div>")
    assert [(c["kind"], c["value"], c["applied"]) for c in E.find_coupons(root)] == coupons and E.find_cash_discount(root) == cash


PAGE = "<html><body><ul>" + "".join(f'<li class="card item"><a href="/p/{i}"><h2>Cafeteira Oster Prima Latte modelo {i}</h2></a><span class="old-price">R$ 1.299,00</span><span class="price">R$ {900 + i},00</span><span>10x de R$ 90,00</span></li>' for i in range(3)) + "</ul></body></html>"


def test_blocks_and_selectors(spark):
    got = [x for s, _, x in E.listings_of(PAGE, "https://loja.com/busca") if s == "blocks"]
    assert [(g["price"], g["list_price"], g["url"]) for g in got] == [(900.0 + i, 1299.0, f"https://loja.com/p/{i}") for i in range(3)]
    assert len(select(parse(PAGE), 'ul > li.card a[href^="/p"], p')) == 3
    got = [x for s, _, x in E.listings_of(PAGE, "https://loja.com", {"item": "li.card", "name": "h2", "price": ".price", "link": "a"}) if s == "selectors"]
    assert [g["price"] for g in got] == [900.0, 901.0, 902.0]
    data = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Notebook","offers":{"@type":"AggregateOffer","lowPrice":"10,50"},"gtin13":"789"}]}</script><script id="__NEXT_DATA__">{"a":[{"name":"Mouse sem fio","price":9999900}]}</script><div itemtype="http://schema.org/Product"><b itemprop="name">Teclado</b><i itemprop="price" content="20.00"></i></div>'
    found = {s: x for s, _, x in E.listings_of(data, "https://a.b/")}
    assert found["jsonld"]["price"] == 10.5 and found["jsonld"]["available"] and found["state"]["price"] == 99999.0 and found["microdata"]["price"] == 20.0
    pages = spark.createDataFrame([(1, "https://loja.com/busca", PAGE), (2, None, None), (3, "x", "")], "page_id long, url string, html string")
    from precioscope.operators.listings import chosen_listings

    assert chosen_listings(E.extract_listings(pages)).count() == 3 and E.read_pages(pages).count() == 3


@pytest.mark.parametrize(
    "path,disallow,allow,ok",
    [
        ("/busca?q=cafeteira", [], [], True),
        ("/busca?q=cafeteira", ["/busca"], [], False),
        ("/busca?q=x", ["/admin", "/checkout"], [], True),
        ("/produto/cafeteira-oster", ["/"], ["/produto/"], True),
        ("/carrinho", ["/"], ["/produto/"], False),
        ("/produto/interno/x", ["/produto/interno"], ["/produto"], False),
        ("/loja/123/interno", ["/loja/*/interno"], [], False),
        ("/loja/123/publico", ["/loja/*/interno"], [], True),
        ("/manual.pdf", ["/*.pdf$"], [], False),
        ("/manual.pdf?v=2", ["/*.pdf$"], [], True),
        ("/busca", ["/[("], [], True),
        ("/x", ["/x"], ["/x"], True),
    ],
)
def test_robots(spark, path, disallow, allow, ok):
    df = spark.createDataFrame([(path, disallow, allow)], "p string, d array<string>, a array<string>")
    assert df.select(P.robots_allows(F.col("p"), F.col("d"), F.col("a"))).first()[0] == ok


def test_robots_file(spark):
    body = "User-agent: x\nDisallow: /no\nUser-agent: *\r\nDisallow: /Busca\nAllow: /ok\nCrawl-delay: 2"
    got = P.robots_rules(spark.createDataFrame([("h", body)], "host string, body string")).collect()
    assert sorted((r["kind"], r["path"]) for r in got) == [("allow", "/ok"), ("crawl-delay", "2"), ("disallow", "/busca")]


def test_affiliate(spark):
    schema = "url string, a struct<kind:string,key:string,value:string,template:string,merchant:string,affiliate:string,ref:string>"
    u = "https://loja.com/p?x=1"
    cases = [
        (None, u),
        (("parameter", "tag", "eu", None, None, None, None), u + "&tag=eu"),
        (("parameter", "x", "2", None, None, None, None), "https://loja.com/p?x=2"),
        (("parameter", None, "2", None, None, None, None), u),
        (("path", None, "c 1", "https://r.io/?u={url}&c={code}", None, None, None), "https://r.io/?u=https%3A%2F%2Floja.com%2Fp%3Fx%3D1&c=c%201"),
        (("suffix", None, "?a=b", None, None, None, None), u + "&a=b"),
        (("network", None, None, None, "7", "9", "r"), "https://www.awin1.com/cread.php?awinmid=7&awinaffid=9&clickref=r&ued=https%3A%2F%2Floja.com%2Fp%3Fx%3D1"),
        (("network", None, None, None, None, "9", None), u),
    ]
    df = spark.createDataFrame([(u, a) for a, _ in cases], schema)
    assert [r[0] for r in df.select(P.affiliate_url(F.col("url"), F.col("a"))).collect()] == [e for _, e in cases]


def test_refusal_and_backoff(spark):
    rows = [(None, ""), (503, "x"), (200, "x"), (200, "y" * 9000), (404, "z" * 9000), (200, "captcha" + "y" * 9000)]
    got = spark.createDataFrame(rows, "s int, h string").select(P.refusal(F.col("s"), F.col("h"))).collect()
    assert [r[0] for r in got] == ["none", "blocked", "shell", "served", "failed", "blocked"]
    seq = [("h", i, s, r) for i, (s, r) in enumerate([(429, None), (429, None), (200, None), (503, 200.0), (200, None)])]
    wait = P.backoff(spark.createDataFrame(seq, "host string, ordinal long, status int, retry_after double")).orderBy("ordinal").collect()
    assert [r["wait_ms"] for r in wait] == [6000, 12000, 6000, 120000, 60000]
