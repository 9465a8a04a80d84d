"""Scalar functions: Column in, Column out, all inside the JVM.

Text is trimmed of white space in the Unicode sense unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that separate the parts of a serial code, as a pattern and one by one (white space in the Unicode sense).
SERIAL_SEPARATORS = r"(?U)[\s\-./]+"
WHITE = " \t\n\v\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = "-./" + WHITE
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c) -> Column:
    return F.btrim(_c(c), F.lit(WHITE))


def squish(c) -> Column:
    """Trimmed, inner white space as one space."""
    return F.regexp_replace(trim(c), r"(?U)\s+", " ")


def blank_to_null(c) -> Column:
    return F.nullif(trim(c), F.lit(""))


def normalize_serial(c) -> Column:
    """Upper case without separators; null gives the empty text."""
    return F.coalesce(F.translate(F.upper(_c(c)), SEPARATORS, ""), F.lit(""))


def sql_normalize_serial(c) -> Column:
    """The database's form: only space, hyphen, slash and dot are dropped."""
    return F.translate(F.upper(F.coalesce(_c(c), F.lit(""))), " -/.", "")


def number_cell(c) -> Column:
    """A cell's number: spaces and apostrophes dropped, comma as point; null if it is none."""
    s = F.translate(F.regexp_replace(_c(c), r"(?U)[\s']", ""), ",", ".")
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def clean_text(c) -> Column:
    """Squished text; null if blank, a formula (=) or an error (#)."""
    return F.nullif(F.regexp_replace(squish(c), "(?s)^[=#].*$", ""), F.lit(""))


def sanitize(c, precision: int, scale: int) -> Column:
    """Rounded half up; null if negative, not finite or too large for the precision."""
    x = _c(c).cast("double")
    rounded = F.round(x, scale)
    limit = 10.0 ** (precision - scale) - 10.0**-scale
    return F.when((x >= 0) & ~F.isnan(x) & (x < float("inf")) & (rounded <= limit), rounded)


def fixed(c, precision: int, scale: int) -> Column:
    """Decimal text with ``scale`` digits; ``null`` for null."""
    return F.coalesce(F.round(_c(c), scale).cast(f"decimal({precision},{scale})").cast("string"), F.lit("null"))


def positive(c) -> Column:
    return F.coalesce(_c(c) > 0, F.lit(False))


def any_metal(pt, pd, rh) -> Column:
    return positive(pt) | positive(pd) | positive(rh)


def assay_text(weight, pt, pd, rh) -> Column:
    return F.concat_ws("|", fixed(weight, 12, 3), fixed(pt, 18, 4), fixed(pd, 18, 4), fixed(rh, 18, 4))


def fingerprint(group, serial, weight, pt, pd, rh) -> Column:
    """Identity of an analysis; null unless group, serial, a weight and a metal are there."""
    key = normalize_serial(serial)
    valid = F.coalesce(_c(group) != "", F.lit(False)) & (key != "") & positive(weight) & any_metal(pt, pd, rh)
    return F.when(valid, F.sha2(F.concat_ws("|", _c(group), key, assay_text(weight, pt, pd, rh)), 256))


def import_signature(group, serial, weight, pt, pd, rh) -> Column:
    return F.concat_ws("|", F.coalesce(_c(group), F.lit("")), normalize_serial(serial), assay_text(weight, pt, pd, rh))


def enrichment_signature(group, serial, weight, pt, pd, rh, shape) -> Column:
    return F.concat_ws("|", import_signature(group, serial, weight, pt, pd, rh), F.coalesce(F.upper(_c(shape)), F.lit("")))


def feed_hash(slug, serial, url) -> Column:
    return F.sha1(F.concat_ws("|", F.lower(_c(slug)), F.upper(_c(serial)), F.lower(_c(url))))


def header_key(c) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"[^\p{L}\p{N}]+", "")


#: Parts of headers that give a column its role, in order.
HEADER_ROLES = [
    ("serial", ["serialcode", "serial", "converterrefno", "refno", "зав", "катал"]),
    ("model", ["model", "manufacturername", "manufacturer", "brand", "произв", "марка"]),
    ("weight", ["piecekg", "weightofcarrier", "weight", "тегло"]),
    ("extra_codes", ["extracodes", "additionalcodes", "alternativecodes"]),
    ("details", ["details", "additionaldescription", "additionalinfo", "description", "доп", "инф"]),
    ("shape_code", ["shapecode", "shape", "formcode"]),
    ("pt", ["pt"]),
    ("pd", ["pd"]),
    ("rh", ["rh"]),
]


def header_role(c) -> Column:
    """Role of a column by its header, null if it has none."""
    key = header_key(c)
    out = F.lit(None).cast("string")
    for role, parts in reversed(HEADER_ROLES):
        out = F.when(key.rlike("|".join(parts)), F.lit(role)).otherwise(out)
    return out


def sheet_group_name(c) -> Column:
    """Group name of a sheet title: leading ``new`` dropped, squished, upper case."""
    return F.upper(squish(F.regexp_replace(_c(c), r"(?iU)^\s*new\s+", "")))


def title_from_slug(c) -> Column:
    return F.initcap(squish(F.translate(_c(c), "-_", "  ")))


def slug(c) -> Column:
    """Lower-case slug; null if nothing or only a number is left."""
    s = F.translate(F.lower(trim(c)), "_ ", "--")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\-]+", ""), "-+", "-"), "^-|-$", "")
    return F.nullif(F.regexp_replace(s, NUMBER, ""), F.lit(""))


def url_path(c) -> Column:
    return F.coalesce(F.try_parse_url(_c(c), F.lit("PATH")), _c(c))


def brand_slug(page_url, *fallbacks, segment: str = "carbrand") -> Column:
    """The slug after ``segment`` in the path of a page, else the first usable fallback."""
    found = F.nullif(F.regexp_extract(url_path(page_url), rf"(?i)(?:^|/){segment}/([^/]+)", 1), F.lit(""))
    return F.coalesce(slug(found), *(slug(f) for f in fallbacks))


def product_key(url, segment: str = "product") -> Column:
    """Key of the segment after ``product``: leading number dropped, upper case letters and digits."""
    found = F.nullif(F.regexp_extract(url_path(url), rf"(?i)(?:^|/){segment}/([^/]+)", 1), F.lit(""))
    return F.nullif(F.regexp_replace(F.upper(F.regexp_replace(found, r"^\d+-", "")), "[^A-Z0-9]+", ""), F.lit(""))


#: Texts that stand for a missing serial.
NO_SERIAL = ["UNKNOWN", "N/A", "NA", "NONE", "NULL"]
CONTROL_ROW = "KONTROLINIS"
SIGNS = "?./_\\- \t\n\v\f\r"


def usable_serial(c) -> Column:
    """False for blank, control-row, placeholder and sign-only serials."""
    s = F.upper(trim(F.coalesce(_c(c), F.lit(""))))
    return (F.translate(s, SIGNS, "") != "") & ~s.contains(CONTROL_ROW) & ~s.isin(NO_SERIAL)


def alternate_serial(c) -> Column:
    key = normalize_serial(c)
    return usable_serial(c) & (F.length(key) >= 6) & key.rlike(r"\d")


def serial_tokens(c) -> Column:
    return F.filter(F.split(_c(c), r"(?U)[\s,;|]+"), lambda t: t != "")


def serial_families(serial, name) -> Column:
    """Distinct normalised serials: the serial itself, then validated alternates.

    Alternates come from a serial that begins with the product name (the name, the rest and
    the rest's parts), or from the parts of the serial if the name has the same ones.
    """
    s, n = trim(serial), trim(F.coalesce(_c(name), F.lit("")))
    unlike = (n != "") & (normalize_serial(n) != normalize_serial(s))
    begins = F.startswith(F.lower(s), F.lower(n)) & F.substring(s, F.length(n) + 1, F.lit(1)).rlike(r"(?U)\s")
    rest = trim(F.substring(s, F.length(n) + 1, F.length(s)))
    parts, named = serial_tokens(s), serial_tokens(n)
    keys = lambda a: F.array_sort(F.transform(a, normalize_serial))
    same = (F.size(parts) >= 2) & (keys(parts) == keys(named)) & F.forall(parts, alternate_serial)
    none = F.array().cast("array<string>")
    others = F.when(unlike & begins & (rest != ""), F.concat(F.array(n, rest), serial_tokens(rest))).when(unlike & same, parts).otherwise(none)
    all_keys = F.concat(F.array(normalize_serial(s)), F.transform(F.filter(others, alternate_serial), normalize_serial))
    return F.array_distinct(F.filter(all_keys, lambda k: k != ""))


def distinct_ignoring_case(a) -> Column:
    """The first of the values that are equal in lower case, in order."""
    def add(acc, x):
        return F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(a, F.array().cast("array<string>"), add)


def split_codes(c) -> Column:
    """Codes between / ; , | without blanks and repeats."""
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), r"[/;,|]"), trim)
    return distinct_ignoring_case(F.filter(parts, lambda p: p != ""))


def details_text(details, detail, description, card_texts, product_name, markers: tuple[str, ...] = ()) -> Column:
    """Usable details joined by `` | ``, else the product name; URLs, ``markers`` and the metals heading are dropped."""
    def usable(x):
        low = F.lower(x)
        bad = low.contains("http://") | low.contains("https://") | (low == "metals content")
        return reduce(lambda a, m: a | low.contains(m), markers, bad)

    texts = F.concat(F.array(_c(details), _c(detail), _c(description)), F.coalesce(_c(card_texts), F.array().cast("array<string>")))
    good = lambda a: F.array_distinct(F.filter(F.transform(a, squish), lambda x: x.isNotNull() & (x != "") & ~usable(x)))
    first = good(texts)
    return F.nullif(F.array_join(F.when(F.size(first) > 0, first).otherwise(good(F.array(_c(product_name)))), " | "), F.lit(""))


def blank_after_markup(c) -> Column:
    """The trimmed text, or null if nothing is left of it without tags and entities."""
    plain = F.regexp_replace(F.regexp_replace(_c(c), "<[^>]*>", ""), "&(nbsp|#160|#xA0|#32);", " ")
    return F.when(trim(plain) != "", trim(c))


def localized(lang, texts: dict[str, tuple], default: str = "en") -> Column:
    """(title, body, lang): the language asked for only if both its texts are there."""
    title, body = texts[default]
    out = F.struct(trim(F.coalesce(_c(title), F.lit(""))).alias("title"), trim(F.coalesce(_c(body), F.lit(""))).alias("body"), F.lit(default).alias("lang"))
    for code, (t, b) in texts.items():
        if code != default:
            both = (_c(lang) == code) & blank_after_markup(t).isNotNull() & blank_after_markup(b).isNotNull()
            out = F.when(both, F.struct(blank_after_markup(t).alias("title"), blank_after_markup(b).alias("body"), F.lit(code).alias("lang"))).otherwise(out)
    return out


def known_or(c, known: list[str], default: str) -> Column:
    """A value of a fixed set, else the default."""
    return F.when(_c(c).isin(known), _c(c)).otherwise(F.lit(default))


def version_parts(c, parts: int = 4) -> Column:
    numbers = F.transform(F.split(F.coalesce(_c(c), F.lit("0")), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), parts)), 1, parts)


def update_state(current, minimum, latest) -> Column:
    """(required, available) of an installed version."""
    return F.struct((version_parts(current) < version_parts(minimum)).alias("required"), (version_parts(current) < version_parts(latest)).alias("available"))


def weight_in_kg(w) -> Column:
    """Weights over 50 are grams."""
    return F.when(_c(w) > 50, _c(w) / 1000).otherwise(_c(w))


def grams_in_ppm(c) -> Column:
    """Grams in a kilogram as parts per million."""
    return _c(c) * 1000


def replaced_weight(old, new) -> Column:
    """A missing weight, or one over 50 where the new one is in (0, 50], gives way."""
    sound = F.coalesce((_c(new) > 0) & (_c(new) <= 50), F.lit(False))
    return F.when(_c(old).isNull() | ((_c(old) > 50) & sound), _c(new)).otherwise(_c(old))


def first_number(body, paths: list[str], above_zero: bool = False) -> Column:
    """The first of the JSON paths that holds a number (a positive one if asked for)."""
    values = [F.when(F.get_json_object(_c(body), p).rlike(NUMBER), F.get_json_object(_c(body), p).try_cast("double")) for p in paths]
    return F.coalesce(*(F.when(v > 0, v) if above_zero else v for v in values))


#: Envelopes and names of a quote's figures.
WRAPPERS = ["$.data[0]", "$.data", "$.results[0]", "$.results", "$"]
NESTS = ["quote", "payload", "spot", "item", "result", "body"]
CHANGE_PCT = ["changePercent", "percentChange", "change_pct", "pctChange", "changePercentage"]


def quote_node(body) -> Column:
    """The object that holds the figures: the first wrapper that is one, else the root."""
    nodes = [F.get_json_object(_c(body), w) for w in WRAPPERS]
    return F.coalesce(*(F.when(n.startswith("{"), n) for n in nodes))


def quote_bid(body) -> Column:
    node = quote_node(body)
    return first_number(node, ["$.bid", *(f"$.{n}.bid" for n in NESTS)], above_zero=True)


def quote_change_pct(body) -> Column:
    return F.coalesce(first_number(quote_node(body), [f"$.{n}" for n in CHANGE_PCT]), F.lit(0.0))


#: Grams of a troy ounce, for display and for pricing.
OUNCE_SHOWN, OUNCE_PRICED = 31.1035, 31.1043


def spot_row(oz, change) -> Column:
    x, d = F.round(_c(oz), 2), F.round(_c(change), 2)
    direction = F.when(d > 0, "up").when(d < 0, "down").otherwise("flat")
    return F.struct(x.alias("price_oz"), F.round(_c(oz) / OUNCE_SHOWN, 2).alias("price_gram"), d.alias("change_oz"), direction.alias("direction"))


def ratio(c) -> Column:
    """Percentages over 1 as a ratio."""
    return F.when((_c(c) > 1) & (_c(c) <= 100), _c(c) / 100).otherwise(_c(c))


def recovery_rate(c) -> Column:
    """A ratio in 0..1; very small rates were sent as a ratio of percent."""
    r = ratio(c)
    return F.least(F.greatest(F.when((r > 0) & (r <= 0.02), r * 100).otherwise(r), F.lit(0.0)), F.lit(1.0))


def clamped_rate(c) -> Column:
    """A rate of 0..100 as a ratio."""
    return F.least(F.greatest(_c(c).cast("double"), F.lit(0.0)), F.lit(100.0)) / 100


def change_text(pt, pd, rh) -> Column:
    return F.format_string("Pt %.2f%%, Pd %.2f%%, Rh %.2f%%", _c(pt).cast("double"), _c(pd).cast("double"), _c(rh).cast("double"))


def natural_key(c) -> Column:
    """Sort key in which digits compare as numbers and case does not count."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(_c(c)), F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")
