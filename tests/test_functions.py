import pytest
from marlpath.functions import classify, offers, text
from pyspark.sql import functions as F


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(c) for c in df.columns]).alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("url, domain", [
    ("https://www.example.com.mx:443/products/catan", "example.com.mx"), ("WWW.M.Example.com.", "example.com"), ("m.www.example.com", "www.example.com"),
    ("//user@amp.x.org/a", "x.org"), ("", ""), ("shop.example.com/a?b", "shop.example.com"),
])
def test_domains(spark, url, domain):
    assert one(spark, offers.canonical_domain, url) == domain


def test_blocked_domains(spark):
    for domain, hit in (("amazon.com", True), ("smile.amazon.com", True), ("notamazon.com", False), ("example.mx", False)):
        assert one(spark, offers.is_blocked, domain) is hit


@pytest.mark.parametrize("url, hit", [
    ("https://a.mx/products/catan", True), ("https://a.mx/productos//catan?x=1", True), ("https://a.mx/products/", False), ("https://a.mx/blog/x", False), ("https://a.mx/x/Juego/y", True),
])
def test_product_urls(spark, url, hit):
    assert one(spark, offers.is_product_url, url) is hit


@pytest.mark.parametrize("t, raw, price", [
    ("Precio $ 1,299 hoy", "$ 1,299", "1299.00"), ("899.00 MXN", "899.00 MXN", "899.00"), ("mxn 12", "mxn 12", "12.00"), ("gratis", "", ""),
])
def test_prices(spark, t, raw, price):
    assert tuple(one(spark, offers.price_of, t)) == (raw, price)


def test_first_price_and_schema_availability(spark):
    assert tuple(one(spark, lambda a, b: offers.first_price(json_ld=a, text=b), "", "5.00")) == ("text", "5.00")
    assert one(spark, offers.availability_of_schema, "https://schema.org/OutOfStock") == "out_of_stock"
    assert one(spark, offers.availability_of, "No disponible. Agregar al carrito") == "out_of_stock"
    assert one(spark, offers.availability_of, "Agregar al carrito") == "available"


@pytest.mark.parametrize("t, age", [("De 10 a 14 años", 10), ("Edad: 10+", 10), ("Edad: 100+", None), ("tel 5512345678", None), ("Edad mínima recomendada: 8", 8)])
def test_ages(spark, t, age):
    assert one(spark, offers.min_age_of, t) == age


def test_players_and_minutes(spark):
    assert tuple(one(spark, offers.players_of, "De 2 a 4 jugadores")) == (2, 4)
    assert tuple(one(spark, offers.players_of, "Jugadores: 3-5")) == (3, 5)
    assert tuple(one(spark, offers.minutes_of, "30 - 45 min")) == (30, 45)
    assert tuple(one(spark, offers.minutes_of, "60 minutos")) == (60, 60)
    assert tuple(one(spark, offers.minutes_of, "rápido")) == (None, None)


def test_languages(spark):
    assert one(spark, offers.language_of, "English y espanol") == "" and one(spark, offers.language_of, "en castellano") == "es"
    found = one(spark, lambda a, b: offers.language_cascade(title=a, page_text=b), "Catan", "Idioma: ingles")
    assert tuple(found) == ("en", "page_text")


def test_small_extractors(spark):
    assert one(spark, offers.likes_of, "1.2K") == 1200 and one(spark, offers.likes_of, "x") == 0
    assert one(spark, offers.video_id, "https://t.com/@a/video/123?x") == "123"
    assert one(spark, lambda u: offers.social_url(u, "instagram"), "https://www.instagram.com/tienda/?hl=es") == "https://instagram.com/tienda"
    for no in ("https://www.instagram.com/p/abc", "https://instagram.com/Reel/1", "https://example.com/tienda", "https://instagram.com/", "https://notinstagram.com/a"):
        assert one(spark, lambda u: offers.social_url(u, "instagram"), no) == ""
    assert one(spark, lambda u: offers.social_url(u, "facebook"), "https://m.facebook.com//Mi.Tienda/about") == "https://facebook.com/Mi.Tienda"
    assert one(spark, lambda u: offers.social_url(u, "facebook"), "https://facebook.com/sharer/sharer.php?u=x") == ""
    assert one(spark, offers.money, "-1") is None and float(one(spark, offers.money, " 12.5 ")) == 12.5
    platform = lambda url, html, headers=None: one(spark, lambda a, b: offers.platform_of_page(a, b, F.lit(headers)), url, html)
    assert platform("https://tienda.mx", "<script src='https://CDN.shopify.com/x.js'>") == "shopify"
    assert platform("https://tienda.mx", "we moved from shopify to our own shop") == "custom" and platform("https://www.amazon.com.mx/x", "cdn.shopify.com") == "amazon"
    assert platform("https://a.mx", "", '{"server":"DPS/2.0"}') == "godaddy_website_builder" and platform("https://x.myshopify.com/", "wc-ajax=") == "shopify"
    assert platform("https://a.mx", "<link href='/modules/ps_x'> magento_") == "prestashop"


def test_normalisers_differ(spark):
    assert text.fold_title_text("Café & Té-Barista") == "cafe and te barista"
    assert text.fold_import_text("Café & Té: «Oro»!") == "cafe and te oro"
    assert text.fold_store_text("  CAFÉ-Té  Ñ ") == "cafe-te n"
    assert text.fold_item_text("Ñandú – Straße") == "nandu strae"
    assert text.fold_match_text("Año-Nuevo, ¡hoy!") == "ano nuevo hoy"
    assert text.fold_ascii_text("Cœur de Straße æ") == "Coeur de Strasse ae"
    assert one(spark, text.fold_title, "Dominó & Más") == "domino and mas"
    assert one(spark, text.fold_title, None) is None


def test_tokens_and_titles(spark):
    assert one(spark, text.significant_tokens, "catan the exp de") == ["catan", "expansion"]
    assert one(spark, text.significant_tokens, "the of") == ["the", "of"]
    assert one(spark, text.slug_title, "https://a.mx/p/catan-el_juego/?x=1") == "catan el_juego"
    assert one(spark, text.without_site_suffix, "Catan - Base | Tienda - MX") == "Catan - Base"
    assert one(spark, lambda c: text.bounded_text(c, 6), "abcdefgh") == "abc..."
    assert one(spark, lambda a, b: text.listing_tokens(a, b, ("the",)), "The Big Catan", "https://x.mx/catan-5") == ["big", "catan"]


def test_store_classifier(spark):
    yes = one(spark, classify.store_decision, "tienda.mx", "juegos de mesa y catan, agregar al carrito, comprar, mexico")
    assert yes["accepted"] and yes["confidence"] == 1.0 and list(yes["reasons"]) == ["boardgame", "online_store", "mexico"]
    no = one(spark, classify.store_decision, "tienda.com", "juegos de mesa, carrito")
    assert not no["accepted"] and no["confidence"] == 0.49 and no["reasons"][2] == "missing_mexico"
    assert one(spark, classify.store_decision, "amazon.com.mx", "juegos de mesa carrito")["reasons"] == ["blocked_domain"]


def decide(spark, t, publisher="", players=None, minutes=None, age=None):
    b = lambda v: F.lit(v).cast("boolean")
    return one(spark, lambda c, p: classify.item_decision(c, p, b(players), b(minutes), b(age)), t, publisher)


def test_item_classifier(spark):
    game = decide(spark, "catan juego de mesa", "devir", True, True, True)
    assert game["category"] == "LIKELY_BOARDGAME" and game["confidence"] >= 0.75
    paint = decide(spark, "pintura acrilica, paint brush")
    assert paint["category"] == "LIKELY_NON_BOARDGAME" and paint["confidence"] >= 0.75
    assert decide(spark, "catan expansion", "", True)["category"] == "LIKELY_EXPANSION"
    assert tuple(decide(spark, "cosa"))[:2] == ("UNCERTAIN", 0.5) and decide(spark, "cosa")["reasons"] == ["insufficient classification evidence"]
    assert game["reasons"] == ["player count found", "play time found", "minimum age found", "boardgame terms found: juego de mesa", "known boardgame publisher found"]
    assert paint["reasons"] == ["non-boardgame terms found: paint, pintura, acrilica"]
    assert decide(spark, "painted sleevesx")["category"] == "UNCERTAIN"


def test_derived_keywords(spark):
    i = lambda c: c.cast("int")
    found = one(spark, lambda a, b: classify.derived_keywords(i(a), i(b), F.lit(100), F.lit(None).cast("int"), F.lit(3.0), F.lit(9)), "1", "8")
    assert found[0] == "single player" and "party game" in found and "long game" in found and "medium complexity" in found and "families" in found
    assert len(found) == len(set(found))
    assert one(spark, lambda a: classify.derived_keywords(*[F.lit(None).cast("int")] * 6), "x") == []


def test_video_score(spark):
    high = one(spark, lambda t: classify.video_score(t, F.array(F.lit("catan"), F.lit("")), F.array(F.lit("catan")), F.lit(999)), "como jugar catan reglas")
    assert high == 6 + 2 + 7 + 7 + 3
    assert one(spark, lambda t: classify.video_score(t, F.array(F.lit("catan")), F.array(F.lit("catan")), F.lit(0)), "unboxing") == 0
