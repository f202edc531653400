"""Text functions as Column expressions: casing, cleaning, tokens, lexical and structural features.

Null strings count as '' throughout.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brands, corrections, abbreviations, suffixes, colours and keys that the results depend on.
BRANDS = [
    "nike", "adidas", "puma", "mavi", "defacto", "koton", "polo", "colins", "hummel", "skechers",
    "reebok", "lotto", "slazenger", "lufian", "dockers", "avva", "tudors", "altınyıldız", "kiğılı",
    "damat", "beymen", "network", "derimod", "tergan", "bambi", "elle", "hotiç", "kemal tanca",
    "greyder", "lumberjack", "kinetix", "us polo", "u.s. polo", "crocs", "converse", "vans",
    "new balance", "under armour", "columbia", "the north face", "jack jones", "lc waikiki",
    "lcw", "zara", "mango", "bershka", "stradivarius",
]
CORRECTIONS = {
    "nayk": "nike", "addidas": "adidas", "adida": "adidas", "lcw": "lc waikiki", "lcwaikiki": "lc waikiki", "lcv": "lc waikiki",
    "lcvaykiki": "lc waikiki", "defakto": "defacto", "humel": "hummel", "skeçers": "skechers", "skeçer": "skechers",
}
# the words that noise leaves alone
AUGMENT_BRANDS = [
    "nike", "adidas", "puma", "mavi", "defacto", "koton", "lcw", "lc", "waikiki", "zara", "bershka", "colins", "converse", "vans",
    "reebok", "hummel", "skechers", "polo", "us", "levis", "loft", "network", "kigili", "damat",
]
ABBREVIATIONS = {"kg": "kilogram", "gr": "gram", "cm": "santimetre", "no": "numara", "yş": "yaş", "krş": "kuruş", "tl": "lira"}
CASE_SUFFIXES = ["dan", "den", "tan", "ten", "da", "de", "ta", "te", "ya", "ye"]
PLURAL_SUFFIXES = ["ler", "lar"]
COLOURS = [
    "siyah", "beyaz", "gri", "kırmızı", "mavi", "yeşil", "sarı", "pembe", "turuncu",
    "lacivert", "mor", "kahverengi", "bej", "ekru", "haki", "bordo", "altın", "gümüş",
]
ATTRIBUTE_KEYS = ["renk", "materyal", "desen", "kumaş tipi", "ortam", "stil", "kol tipi", "yaka tipi", "boy", "kalıp"]
FEMALE, MALE, CHILD = ["kadın", "kız", "bayan"], ["erkek", "bay"], ["bebek", "çocuk", "baby", "kid"]
WOMAN, MAN, ADULT = "kadın", "erkek", "yetişkin"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def turkish_lower(c: Column) -> Column:
    """Lower case with dotted and dotless i told apart."""
    return F.lower(F.translate(text(c), "İI", "iı"))


def clean_punctuation(c: Column) -> Column:
    """Everything but letters, digits, underscores and white space to spaces; white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def normalise_basic(c: Column) -> Column:
    return clean_punctuation(turkish_lower(c))


def expand_abbreviations(c: Column) -> Column:
    return reduce(lambda x, kv: F.regexp_replace(x, rf"(?U)\b{kv[0]}\b", kv[1]), ABBREVIATIONS.items(), c)


def words(c: Column) -> Column:
    """The parts between single spaces, without empty ones."""
    return F.filter(F.split(text(c), " "), lambda w: w != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def correct_brand(token: Column, brands: list[str] = BRANDS) -> Column:
    """The listed correction of a token, else the smallest brand of more than three letters at edit distance 1, else the token."""
    listed = F.create_map(*[F.lit(x) for kv in CORRECTIONS.items() for x in kv])
    # distance 1 needs lengths within 1; the test keeps most brands from the dynamic programme
    near = F.filter(literal_array([b for b in brands if len(b) > 3]), lambda b: (F.abs(F.length(b) - F.length(token)) <= 1) & (F.levenshtein(token, b) == 1))
    return F.coalesce(F.try_element_at(listed, token), F.array_min(near), token)


def _strip_one(word: Column, suffixes: list[str]) -> Column:
    out = word
    for s in reversed(suffixes):
        out = F.when(word.endswith(s) & (F.length(word) - len(s) >= 3), F.left(word, F.length(word) - len(s))).otherwise(out)
    return out


def stem(word: Column) -> Column:
    """Strip one case suffix, then one plural; brands and words of three letters or fewer stay."""
    fixed = word.isin(BRANDS) | (F.length(word) <= 3)
    return F.when(fixed, word).otherwise(_strip_one(_strip_one(word, CASE_SUFFIXES), PLURAL_SUFFIXES))


def normalise(c: Column, stemming: bool = True) -> Column:
    """Lower case, abbreviations, punctuation, then correction and stem of every word."""
    fix: Callable[[Column], Column] = (lambda w: stem(correct_brand(w))) if stemming else (lambda w: correct_brand(w))  # transform gives a number, too, to what takes two arguments
    return F.array_join(F.transform(words(clean_punctuation(expand_abbreviations(turkish_lower(c)))), fix), " ")


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters; the whole string if it is shorter."""
    s = text(c)
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - 2)), lambda i: F.substr(s, i, F.lit(3)))
    return F.when(F.length(s) < 3, F.array(s)).otherwise(F.array_distinct(many))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def trigram_jaccard(a: Column, b: Column) -> Column:
    return F.when((text(a) == "") | (text(b) == ""), 0.0).otherwise(jaccard(trigrams(a), trigrams(b)))


def coverage(query: Column, title: Column) -> Column:
    """The share of distinct query words that the title has; 0 for an empty query."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, title)).cast("double") / F.greatest(F.lit(1), F.size(query)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def ratio(a: Column, b: Column) -> Column:
    """a / max(1, b)"""
    return a.cast("double") / F.greatest(F.lit(1), b)


def brand_in_query(brand: Column, query: Column, skip: str = "unknown") -> Column:
    """Whether a query holds the brand; ``skip`` and '' aren't brands."""
    b = text(brand)
    return F.when((b != "") & (b != skip) & text(query).contains(b), 1.0).otherwise(0.0)


def _any_of(c: Column, values: list[str]) -> Column:
    return reduce(lambda x, v: x | text(c).contains(v), values, F.lit(False))


def gender_contradiction(query: Column, gender: Column, bounded: bool = False) -> Column:
    """1.0 if a query for one sex meets an item for the other. ``bounded``: 'bay' counts only as a whole word; else also
    within 'bayan'."""
    male = (text(query).contains("erkek") | text(query).rlike(r"(?U)\bbay\b")) if bounded else _any_of(query, MALE)
    return F.when(_any_of(query, FEMALE) & (gender == MAN), 1.0).when(male & (gender == WOMAN), 1.0).otherwise(0.0)


def age_contradiction(query: Column, age_group: Column) -> Column:
    return F.when(_any_of(query, CHILD) & (age_group == ADULT), 1.0).otherwise(0.0)


def attribute(attributes: Column, key: str) -> Column:
    """The trimmed value after the first ``key:`` up to a comma, of lower-cased text; null without one."""
    low = F.lower(text(attributes))
    pattern = rf"\Q{key}\E:\s*([^,]+)"
    return F.when(low.rlike(pattern), F.trim(F.regexp_extract(low, pattern, 1)))


def colour_match(query: Column, title: Column, attributes: Column) -> tuple[Column, Column]:
    """(match, mismatch): the item's colour attribute against the query's colours, else its title."""
    asked = F.filter(literal_array(COLOURS), lambda c: text(query).contains(c))
    own = F.coalesce(attribute(attributes, "renk"), F.lit(""))
    same = F.exists(asked, lambda c: own.contains(c)) | F.array_contains(asked, own)
    titled = F.exists(asked, lambda c: text(title).contains(c))
    some = F.size(asked) > 0
    match = F.when(some & (own != "") & same, 1.0).when(some & (own == "") & titled, 1.0).otherwise(0.0)
    return match, F.when(some & (own != "") & ~same, 1.0).otherwise(0.0)


def category_root(c: Column) -> Column:
    return F.get(F.split(F.coalesce(c, F.lit("unknown")), "/"), F.lit(0))


def category_leaf(c: Column) -> Column:
    return F.element_at(F.split(text(c), "/"), -1)


def category_depth(category: Column, query_words: Column) -> tuple[Column, Column]:
    """(deepest level, from 0, that shares a word with the query, or -1; how many levels do)."""
    levels = F.transform(F.filter(F.split(text(category), "/"), lambda x: x != ""), lambda x: turkish_lower(clean_punctuation(x)))
    at = F.filter(F.transform(levels, lambda x, i: F.when(F.arrays_overlap(words(x), query_words), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(at), F.lit(-1)).cast("double"), F.size(at).cast("double")


def latin_tokens(c: Column) -> Column:
    """Runs of a-z, digits and the Turkish letters of plainly lower-cased text; İ isn't mapped, so a token splits at its dot."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9çğıöşü]+"), F.lit(0))


def stacker_lexical(query: Column, title: Column) -> tuple[Column, Column, Column, Column]:
    """(shared, shared / max(1, union), query tokens, title tokens) of distinct latin tokens."""
    q, t = F.array_distinct(latin_tokens(query)), F.array_distinct(latin_tokens(title))
    return overlap(q, t), ratio(overlap(q, t), F.size(F.array_union(q, t))), F.size(q), F.size(t)


def _known(c: Column) -> Column:
    return c.isNotNull() & (c != "") & (F.lower(c) != "unknown")


def product_text(title: Column, category: Column, attributes: Column, brand: Column | None = None, gender: Column | None = None, cut: int = 90) -> Column:
    parts = [F.left(text(title), F.lit(cut)), F.concat(F.lit("["), category_leaf(category), F.lit("]"))]
    if brand is not None:
        parts.append(F.when(_known(brand), F.concat(F.lit("marka:"), brand)))
    if gender is not None:
        parts.append(F.when(_known(gender), gender))
    parts += [F.concat(F.lit(f"{k}:"), attribute(attributes, k)) for k in ("renk", "materyal")]
    return F.trim(F.concat_ws(" ", *parts))


def document_text(title: Column, brand: Column, category: Column, gender: Column, age_group: Column, attributes: Column, rich: bool = True) -> Column:
    none = lambda c: F.coalesce(c, F.lit(""))
    if not rich:
        return F.concat(
            text(title), F.lit(" . marka "), text(brand), F.lit(" kategori "), category_leaf(category),
            F.lit(" renk "), none(attribute(attributes, "renk")), F.lit(" materyal "), none(attribute(attributes, "materyal")),
        )
    parts = [text(title), F.concat(F.lit("marka "), text(brand)), F.concat(F.lit("kategori "), F.replace(text(category), F.lit("/"), F.lit(" > "))), F.concat(text(gender), F.lit(" "), text(age_group))]
    parts += [F.concat(F.lit(f"{k} "), attribute(attributes, k)) for k in ATTRIBUTE_KEYS]
    return F.concat_ws(" . ", *parts)


def with_prefix(c: Column, kind: str, model: str = "e5") -> Column:
    """``query: `` or ``passage: `` before the text, for the models that were trained with them."""
    return F.concat(F.lit(f"{kind}: "), text(c)) if "e5" in model else text(c)


def hash_number(*parts: Column) -> Column:
    """A number in [0, 2^32) from keys and seeds, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def perturb_query(query: Column, key: Column, seed: int = 42, brands: list[str] = AUGMENT_BRANDS) -> Column:
    """A query with a word dropped, a typo, or both, chosen by a hash of ``key``; null if it has fewer than two words or didn't change.

    With probability 0.45 a word goes (of three or more), up to 0.9 one word gets a typo, else both. A typo takes the first
    word, counted from a hashed place, of four letters or more that is no brand: neighbours swap (0.4), or a letter goes or
    doubles (0.3 each).
    """
    draw = lambda what: (hash_number(key, F.lit(seed), F.lit(what)) / F.lit(float(2**32))).alias(what)

    def typo(ws: Column, p: Column) -> Column:
        n = F.greatest(F.size(ws), F.lit(1))

        def found(start: Column) -> Column:
            places = F.transform(ws, lambda x, i: F.struct(F.pmod(i - start, n).alias("o"), i.alias("i"), x.alias("x")))
            return F.array_min(F.filter(places, lambda s: (F.length(s["x"]) >= 4) & ~F.lower(s["x"]).isin(brands)))

        def changed(chosen: Column) -> Column:
            x, kind = chosen["x"], p["typo"]
            at = (F.floor(p["letter"] * (F.length(x) - 1)) + 1).cast("int")
            head, one, two, tail = F.left(x, at - 1), F.substr(x, at, F.lit(1)), F.substr(x, at + 1, F.lit(1)), F.substr(x, at + 2)
            new = F.when(kind < 0.4, F.concat(head, two, one, tail)).when(kind < 0.7, F.concat(head, two, tail)).otherwise(F.concat(head, one, one, two, tail))
            return F.when(chosen.isNull(), ws).otherwise(F.transform(ws, lambda y, i: F.when(i == chosen["i"], new).otherwise(y)))

        return _let(_let(F.floor(p["word"] * n).cast("int"), found), changed)

    def noisy(w: Column, p: Column) -> Column:
        drop_at = F.floor(p["drop"] * F.size(w)).cast("int")
        dropped, can_drop = F.filter(w, lambda x, i: i != drop_at), F.size(w) > 2
        base = F.when(can_drop & (p["kind"] >= 0.9), dropped).otherwise(w)
        out = F.when(can_drop & (p["kind"] < 0.45), dropped).otherwise(_let(base, lambda ws: typo(ws, p)))
        return _let(F.array_join(out, " "), lambda joined: F.when((F.size(w) >= 2) & (joined != F.array_join(w, " ")), joined))

    draws = F.struct(*[draw(x) for x in ("kind", "drop", "word", "letter", "typo")])
    return _let(words(query), lambda w: _let(draws, lambda p: noisy(w, p)))


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)
