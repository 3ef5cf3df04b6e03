"""Prices, plans and conditions of product pages; failures in quarantine."""

from precioscope.functions import extract as E
from precioscope.functions.dom import parse


def page(body):
    return E.product_page(f"<html><body><h1>Cadeira de jantar</h1>{body}</body></html>", "https://a.b/p")


def test_instalments_without_currency_are_no_price():
    assert page("<span>10x de 10,45</span>")["price"] == 104.5
    assert page("<b>R$ 104,50</b><span>10x de R$ 10,45 sem juros</span>")["instalments"] == {"times": 10, "amount": 10.45, "no_interest": True, "total": 104.5}
    assert page("<b>R$ 100,00</b><span>24x de R$ 19,60</span>")["instalments"] is None
    assert page("<b>R$ 100,00</b><p>12x de R$ 9,90 ou 10x de R$ 10,00 sem juros</p>")["instalments"]["times"] in (10, 12)


def test_condition_and_cash():
    got = page("<div><b>R$ 800,00</b> <i>no pix</i></div><p>x</p>" + "<p>Produto original com nota fiscal e garantia de doze meses</p><p>5% off no pix</p>")
    assert got["condition"] == "pix" and got["cash"] is None
    got = page("<div><b>R$ 800,00</b></div><p>5% de desconto à vista no pix</p>")
    assert got["condition"] is None and got["cash"] is not None
    assert page("<b>R$ 800,00</b> à vista")["condition"] == "à vista" and page("<b>R$ 800,00</b> no boleto")["condition"] == "boleto"


def test_leading_is_a_chain_of_filters_with_fall_back():
    odd, big = (lambda x: x % 2), (lambda x: x > 5)
    assert E.leading([2, 3, 7, 9], odd, big) == [7, 9] and E.leading([2, 4, 8], odd, big) == [8] and E.leading([1, 2], odd, big) == [1] and E.leading([], odd) == []


def test_quarantine_and_counters(spark, tmp_path, monkeypatch):
    from precioscope.plans.quarantine import listings_at, quarantine_at, store_extraction

    good = '<script type="application/ld+json">{"@type":"Product","name":"Cadeira","offers":{"price":"9.90"}}</script>'
    pages = spark.createDataFrame([(1, "https://a.b", good), (2, "https://a.b", good.replace("}}", "}")), (3, None, None), (4, "https://a.b", good + '<script type="application/json">{</script>')], "page_id long, url string, html string")
    assert store_extraction(pages, f"{tmp_path}/x") == {"listings": 2, "priced": 2, "failures": 2}
    assert sorted(map(tuple, quarantine_at(spark, f"{tmp_path}/x").collect())) == [(2, "jsonld", "script 0 is not JSON"), (4, "state", "script 1 is not JSON")]
    assert {r["page_id"] for r in listings_at(spark, f"{tmp_path}/x").collect()} == {1, 4}


def test_a_failing_strategy_leaves_its_reason(monkeypatch):
    def fail(root, base):
        raise ValueError("odd block")

    monkeypatch.setattr(E, "from_blocks", fail)
    assert list(E.read_strategies("<p>x</p>", None)) == [("blocks", None, "ValueError: odd block")]
    assert parse("<p>x</p>") is not None
