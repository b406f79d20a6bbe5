"""Rule-based classifiers of stores and items, and derived texts, as column expressions over folded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .offers import is_blocked

#: Words of games, of selling online and of Mexico in a store's pages.
GAME_TERMS = (
    "board game", "boardgame", "calabozos", "cartas coleccionables", "cartas intercambiables", "carcassonne", "catan", "d&d", "dungeons",
    "dungeons and dragons", "eurogame", "juego de cartas", "juego de mesa", "juegos de cartas", "juegos de mesa", "juegos de rol",
    "juegos de tablero", "juegos familiares", "juegos tcg", "magic the gathering", "meeple", "miniaturas", "mtg", "pokemon tcg", "tcg",
    "warhammer", "wargames", "yugioh",
)
SHOP_TERMS = (
    "/cart", "/carrito", "/checkout", "/collections/", "/product-category/", "/producto/", "/productos/", "/products/", "/shop/", "/tienda/",
    "agregar al carrito", "anadir al carrito", "carrito", "catalogo", "checkout", "compra en linea", "comprar", "comprar ahora", "ecommerce",
    "envio", "envios", "finalizar compra", "mxn", "pedido", "pedidos", "precio", "precio regular", "producto", "productos", "shopify", "sku",
    "tienda en linea", "tienda online", "ver carrito", "woocommerce",
)
PLACE_TERMS = (
    "+52", "$ mxn", "a todo mexico", "aguascalientes", "baja california", "baja california sur", "campeche", "cdmx", "chiapas", "chihuahua",
    "ciudad de mexico", "coahuila", "colima", "durango", "envios a mexico", "envios nacionales", "estado de mexico", "guanajuato", "guerrero",
    "guadalajara", "hidalgo", "jalisco", "mexican", "mexico", "monterrey", "morelos", "nayarit", "nuevo leon", "oaxaca", "pesos", "puebla",
    "quintana roo", "queretaro", "san luis potosi", "sinaloa", "sonora", "tabasco", "tamaulipas", "tlaxcala", "veracruz", "yucatan", "zacatecas",
)
#: Words for and against an item being a board game, and publishers of such.
ITEM_TERMS = ("board game", "boardgame", "juego de mesa", "juegos de mesa", "family game", "familiar", "familiares", "party game", "estrategia", "cooperativo", "jugadores", "turnos")
EXPANSION_TERMS = ("expansion", "ampliacion", "expande", "requiere el juego base", "requires base game")
OTHER_TERMS = (
    "paint", "pintura", "acrilica", "acrilico", "brush", "pincel", "glue", "pegamento", "hobby color", "sleeve", "sleeves", "protectores",
    "deck box", "binder", "dados", "dice set", "miniature", "miniatura", "terrain", "warhammer", "magic the gathering", "pokemon tcg",
    "yu-gi-oh", "booster", "single card",
)
PUBLISHERS = ("devir", "asmodee", "libellud", "horrible guild", "fantasy flight", "z-man", "days of wonder", "maldito")


def hits(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that the text contains anywhere."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: text.contains(t))


def word_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that the text holds as whole words."""
    cases = [F.when(text.rlike(r"(^|\W)\Q" + t + r"\E($|\W)"), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*cases))


def store_decision(domain: Column, text: Column) -> Column:
    """(accepted, confidence, reasons) of a store candidate from its domain and its folded text."""
    games, shops, places = (F.size(hits(text, t)) for t in (GAME_TERMS, SHOP_TERMS, PLACE_TERMS))
    local = domain.endswith(".mx")
    accepted = (games > 0) & (shops > 0) & ((places > 0) | local)
    points = F.lit(0)
    for condition, weight in ((games > 0, 34), (shops > 0, 31), (places > 0, 22), (local, 10), (games > 1, 2), (shops > 1, 1)):
        points = points + F.when(condition, weight).otherwise(0)
    confidence = F.least(points, F.lit(100)) / 100.0
    reason = lambda ok, yes: F.when(ok, yes).otherwise(f"missing_{yes}")
    blocked = is_blocked(domain)
    return F.struct(
        (accepted & ~blocked).alias("accepted"),
        F.when(blocked, 0.0).when(accepted, confidence).otherwise(F.least(confidence, F.lit(0.49))).alias("confidence"),
        F.when(blocked, F.array(F.lit("blocked_domain")))
        .otherwise(F.array(reason(games > 0, "boardgame"), reason(shops > 0, "online_store"), reason((places > 0) | local, "mexico")))
        .alias("reasons"),
    )


def item_decision(text: Column, publisher: Column, players: Column, minutes: Column, age: Column) -> Column:
    """(category, confidence, reasons) of an item from its folded text and publisher and from whether players, minutes and age are known.

    A reason names three terms at most; where there is none, the last one says so.
    """
    number = F.size(word_hits(text, ITEM_TERMS))
    known = F.lit(False)
    for p in PUBLISHERS:
        known = known | publisher.contains(p)
    yes = F.coalesce
    points = (
        F.when(yes(players, F.lit(False)), 0.35).otherwise(0.0)
        + F.when(yes(minutes, F.lit(False)), 0.2).otherwise(0.0)
        + F.when(yes(age, F.lit(False)), 0.15).otherwise(0.0)
        + F.least(F.lit(0.45), number * 0.15)
        + F.when(yes(known, F.lit(False)), 0.3).otherwise(0.0)
    )
    expansion = F.size(word_hits(text, EXPANSION_TERMS)) > 0
    against = F.least(F.lit(0.85), F.size(word_hits(text, OTHER_TERMS)) * 0.25)
    sure = lambda x: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(0.99), x)), 2)
    none = F.array().cast("array<string>")
    say = lambda condition, text: F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(text))).otherwise(none)
    found = lambda what, terms: F.when(F.size(word_hits(text, terms)) > 0, F.array(F.concat(F.lit(f"{what} terms found: "), F.array_join(F.slice(word_hits(text, terms), 1, 3), ", ")))).otherwise(none)
    # fixed values: the texts of the reasons
    reasons = F.concat(
        say(players, "player count found"), say(minutes, "play time found"), say(age, "minimum age found"), found("boardgame", ITEM_TERMS),
        say(known, "known boardgame publisher found"), found("expansion", EXPANSION_TERMS), F.when(expansion, none).otherwise(found("non-boardgame", OTHER_TERMS)),
    )
    reasons = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("insufficient classification evidence")))
    made = lambda name, x: F.struct(F.lit(name).alias("category"), sure(x).alias("confidence"), reasons.alias("reasons"))
    return (
        F.when(expansion, made("LIKELY_EXPANSION", 0.75 + (points + 0.3) / 4))
        .when(points >= 0.5, made("LIKELY_BOARDGAME", 0.65 + points / 3))
        .when(against >= 0.5, made("LIKELY_NON_BOARDGAME", 0.65 + against / 3))
        .when(points > 0, made("LIKELY_BOARDGAME", 0.55 + points / 4))
        .otherwise(made("UNCERTAIN", F.lit(0.5)))
    )


def auto_confirmed(decision: Column) -> Column:
    return (decision["category"] == "LIKELY_NON_BOARDGAME") & (decision["confidence"] > 0.6)


#: Keywords that follow from numbers of players, minutes, complexity and age.
SOLO = ("single player", "solo", "solitaire", "one player", "un jugador", "juego en solitario", "solitario")
DUEL = ("two player", "duel", "head to head", "dos jugadores", "duelo")
GROUP = ("large group", "many players", "group game", "grupo grande", "muchos jugadores")
PARTY = ("party game", "fiesta", "juego para fiestas")
SHORT = ("short duration", "quick game", "fast game", "juego corto", "partida rapida")
MEDIUM = ("medium duration", "standard length", "duracion media", "partida media")
LONG = ("long duration", "long game", "juego largo", "partida larga")
LIGHT = ("light complexity", "easy to learn", "beginner friendly", "baja complejidad", "facil de aprender", "ligero")
MIDDLE = ("medium complexity", "moderate strategy", "intermediate", "complejidad media", "estrategia moderada", "intermedio")
HEAVY = ("high complexity", "heavy strategy", "expert game", "alta complejidad", "estrategico", "para expertos")
KIDS = ("kids", "children", "family friendly", "ninos", "infantil", "familiar", "para familia")
FAMILY = ("family friendly", "families", "familiar", "para familia")
TEENS = ("teens", "teen friendly", "adolescentes", "para adolescentes")
ADULTS = ("adult gamers", "older players", "jugadores adultos", "publico adulto")


def words_if(*cases: tuple[Column, tuple[str, ...]]) -> Column:
    """The words of every case that holds, in order."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(F.coalesce(c, F.lit(False)), F.array(*[F.lit(w) for w in words])).otherwise(none) for c, words in cases])


def derived_keywords(min_players: Column, max_players: Column, min_minutes: Column, max_minutes: Column, complexity: Column, min_age: Column) -> Column:
    """Distinct keywords in a fixed order; a missing bound is the other one."""
    low, high = F.coalesce(min_players, max_players), F.coalesce(max_players, min_players)
    short, long = F.coalesce(min_minutes, max_minutes), F.coalesce(max_minutes, min_minutes)
    return F.array_distinct(
        words_if(
            (low <= 1, SOLO), ((low == 2) & (high == 2), DUEL), (high >= 5, GROUP), (high >= 8, PARTY),
            (long < 45, SHORT), ((long >= 45) & (short <= 90), MEDIUM), ((short > 90) | (long > 90), LONG),
            (complexity < 2, LIGHT), ((complexity >= 2) & (complexity <= 3.5), MIDDLE), (complexity > 3.5, HEAVY),
            (min_age <= 8, KIDS), ((min_age > 8) & (min_age <= 10), FAMILY), ((min_age > 10) & (min_age <= 13), TEENS), (min_age > 13, ADULTS),
        )
    )


def labelled_lines(lines: dict[str, Column], keywords: Column) -> Column:
    """"Label: value" lines (arrays joined by ", "), and one of derived keywords if there are any."""
    parts = [F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit(""))) for label, value in lines.items()]
    words = F.when(F.size(keywords) > 0, F.concat(F.lit("Derived keywords: "), F.array_join(keywords, ", ")))
    return F.concat_ws("\n", *parts, words)


#: Signs of a tutorial, of an overview and of neither in a video's text.
TUTORIAL = ("como jugar", "como se juega", "tutorial", "explicar", "explicado", "reglas", "guia")
TEACHING = ("aprende", "aprendiendo", "enseno", "ensenamos")
OVERVIEW = ("conoce", "conocer", "conoceremos", "vista rapida", "resena", "review", "que es", "juegazo")
WEAK = ("unboxing", "destroquel", "comprar", "top ", "mejores que")
#: Tags of videos on board games.
TAGS = ("juegosdemesa", "juego de mesa", "boardgame")


def video_score(text: Column, names: Column, tokens: Column, likes: Column) -> Column:
    """How well a video's folded text suits an item: its ``names`` and their ``tokens`` (arrays; of each name), tutorial and overview signs, likes; at least 0, one decimal."""
    count = lambda terms: F.size(hits(text, terms))
    score = (
        6.0 * F.size(F.filter(names, lambda n: (n != "") & text.contains(n)))
        + 2.0 * F.size(F.filter(tokens, lambda t: text.contains(t)))
        + 7.0 * count(TUTORIAL) + 5.0 * count(TEACHING) + 4.0 * count(OVERVIEW)
        + F.when(F.size(hits(text, TAGS)) > 0, 2.0).otherwise(0.0)
        - 2.5 * count(WEAK)
        + F.least(F.lit(4.0), F.log10(likes + 1))
    )
    return F.bround(F.greatest(score, F.lit(0.0)), 1)
