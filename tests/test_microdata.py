"""Microdata laid beside a page's listings by position."""

import pytest

from hearthgrid.sources import microdata

ROWS = "page_id long, pos int, url string, base string, price double, price_uf double, direct boolean, in_uf boolean"
BASE = "https://homes.example/lista"


def filled(spark, html, *rows):
    df = spark.createDataFrame([(1, i, BASE, BASE, r.get("price"), r.get("uf"), r.get("direct", False), r.get("in_uf")) for i, r in enumerate(rows)], ROWS)
    out = microdata.fill_by_microdata(df, spark.createDataFrame([(1, html)], "page_id long, html string"))
    return [(r["url"].removeprefix("https://homes.example"), r["price"], r["price_uf"], r["operation"]) for r in out.orderBy("pos").collect()]


def card(kind, price, link="/ficha/1"):
    return f"<div itemscope itemtype='https://schema.org/{kind}/'><a href='{link}'>t</a><p itemprop='price'>{price}</p></div>"


def test_one_item_for_each_row(spark):
    html = card("Product", "$ 700.000") + card("Product", "<b>900</b>.000", "/ficha/2?x=1")
    assert filled(spark, html, {}, {}) == [("/ficha/1", 700_000.0, None, None), ("/ficha/2?x=1", 900_000.0, None, None)]
    assert filled(spark, html, {"price": 1.0, "direct": True}, {"uf": 3.0}) == [("/lista", 1.0, None, None), ("/ficha/2?x=1", None, 3.0, None)]
    assert filled(spark, html, {}) == [("/lista", None, None, None)]
    assert filled(spark, None, {}) == filled(spark, "", {}) == [("/lista", None, None, None)]


def test_the_outermost_type_that_fits(spark):
    inner = "<div itemtype='http://schema.org/Product'><i itemtype='http://schema.org/Offer'><meta itemprop=price content='800000'></i></div>"
    extra = "<div itemtype='http://schema.org/Product'><meta itemprop=price content='500000'></div>"
    assert filled(spark, inner, {})[0][1] == 800_000.0
    assert filled(spark, extra + inner, {})[0][1] == 800_000.0  # two products, one offer
    assert filled(spark, "<div itemtype='http://schema.org/Product'>no price</div>" + inner, {})[0][1] == 800_000.0


@pytest.mark.parametrize(("price", "in_uf", "want"), [("110", True, (4_488_000.0, 110.0, None)), ("110", None, (None, None, None)), ("3.085.000", True, (3_085_000.0, None, None)), ("18.500", True, (None, None, "venta")), ("18.500", False, (None, None, None)), ("consultar", True, (None, None, None)), ("", True, (None, None, None))])
def test_size_tells_the_unit_where_the_label_is_wrong(spark, price, in_uf, want):
    assert filled(spark, card("Apartment", price), {"in_uf": in_uf})[0][1:] == want


def test_links_that_lead_to_no_listing():
    for link in ("#top", "javascript:x()", "mailto:a@b", "/venta/depto", "https://x.example/contactanos", "/x/3-dormitorios/", "/a?applied_filter_id=1", "/publicar?x"):
        assert microdata.leads_to_no_listing(link), link
    for link in ("/ficha/1", "/ventanas/3", "/depto-3-dormitorios-centro", "https://x.example/a/blogs"):
        assert not microdata.leads_to_no_listing(link), link
