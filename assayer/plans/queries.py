"""The registered queries of the catalog operators, each on its whole tables, with the SQL that gives the same rows.

Names begin with the identifiers of the operators they run.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import quality as Q
from ..operators import dedupe, enrich, hamming, match, neighbours, price, rank, report, search, textindex
from ..sources import arrays, io, versions
from ..sources.shared import saved, shared_folder
from . import jobs
from .proxies import Tables, with_sql

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
FIGURES = jobs.FIGURES


def query(sql: str, *proxies: str):
    """Registers a function of the tables together with its SQL."""

    def register(f):
        def run(spark, sf_dir: str) -> DataFrame:
            df = f(Tables(spark, sf_dir))
            return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))

        QUERIES[f.__name__] = run
        if sql:
            head = with_sql(*proxies) if proxies else ""
            SQL[f.__name__] = head + (", " + sql.strip()[5:] if head and sql.strip()[:5].upper() == "WITH " else " " + sql)
        return f

    return register


# forms of scalar functions in DuckDB
def ns(x: str) -> str:
    return rf"coalesce(regexp_replace(upper({x}), '[\s\-./]+', '', 'g'), '')"


def fx(x: str, p: int, s: int) -> str:
    return f"coalesce(CAST(CAST(round({x}, {s}) AS DECIMAL({p},{s})) AS VARCHAR), 'null')"


ASSAY = "concat_ws('|', " + ", ".join([fx("weight_kg", 12, 3), *(fx(f"{m}_ppm", 18, 4) for m in ("pt", "pd", "rh"))]) + ")"
METAL = "(coalesce(pt_ppm, 0) > 0 OR coalesce(pd_ppm, 0) > 0 OR coalesce(rh_ppm, 0) > 0)"
PRICEABLE = f"(coalesce(weight_kg, 0) > 0 AND {METAL})"
FP = f"CASE WHEN {ns('serial_code')} <> '' AND {PRICEABLE} THEN sha256(concat_ws('|', group_id, {ns('serial_code')}, {ASSAY})) END"
HELD = "CASE WHEN slot % 3 = 0 THEN {0} ELSE {0} / 1000 END"
SIG = f"concat_ws('|', group_id, {ns('serial_code')}, {ASSAY})"
UPTRIM = "upper(trim(coalesce(serial_code, '')))"
USABLE = rf"({UPTRIM} <> '' AND NOT contains({UPTRIM}, 'KONTROLINIS') AND {UPTRIM} NOT IN ('UNKNOWN', 'N/A', 'NA', 'NONE', 'NULL') AND NOT regexp_matches({UPTRIM}, '^[?./_\\\-\s]+$'))"
NUM = r"'^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$'"
GRAM = "31.1043"
SPOT = "spot AS (SELECT max(CASE WHEN key = 'pt' THEN price_oz END) AS pt_oz, max(CASE WHEN key = 'pd' THEN price_oz END) AS pd_oz, max(CASE WHEN key = 'rh' THEN price_oz END) AS rh_oz FROM (SELECT key, arg_max(price_oz, struct_pack(a := \"at\", e := event_id)) AS price_oz FROM quotes GROUP BY key))"


def fp_of(form: str) -> str:
    """FP with another form of the figures of metals."""
    return re.sub(r"(?:pt|pd|rh)_ppm", lambda m: f"({form.format(m[0])})", FP)


def value_sql(rate: str) -> str:
    total = " + ".join(f"coalesce({m}_ppm, 0) * coalesce(CASE WHEN {m}_oz > 0 THEN {m}_oz / {GRAM} END, 0)" for m in ("pt", "pd", "rh"))
    return f"CASE WHEN {PRICEABLE} THEN round(greatest(weight_kg / 1000 * ({total}) * {rate}, 0), 2) ELSE 0 END"


def latest_spot(t: Tables) -> DataFrame:
    return price.spot_pivot(price.latest_per_key(t.quotes.select("key", "at", "event_id", "price_oz"), "key", "at", "event_id", "price_oz"))


@query(f"WITH {SPOT} SELECT item_id, group_id, {value_sql('0.8')} AS price FROM items, spot WHERE {PRICEABLE} ORDER BY price DESC, item_id LIMIT 20", "items", "quotes")
def e2_p1_p6_c21_top_values(t: Tables) -> DataFrame:
    """Flagship: the 20 most valuable priceable items at the latest quotes."""
    priced = price.priced(t.items.filter(Q.priceable()), latest_spot(t))
    return priced.orderBy(F.desc("price"), "item_id").limit(20).select("item_id", "group_id", "price")


@query(f"SELECT row_no, {ns('serial_code')} AS h1, translate(upper(coalesce(serial_code, '')), ' -/.', '') AS h2, {ASSAY} AS h6, {FP} AS h7, {SIG} AS h8, concat_ws('|', {SIG}, coalesce(upper(shape_code), '')) AS h8e FROM items", "items")
def h1_h2_h6_h7_h8_identity(t: Tables) -> DataFrame:
    a = ("group_id", "serial_code", *FIGURES)
    return t.items.select("row_no", C.normalize_serial("serial_code").alias("h1"), C.sql_normalize_serial("serial_code").alias("h2"), C.assay_text(*FIGURES).alias("h6"), C.fingerprint(*a).alias("h7"), C.import_signature(*a).alias("h8"), C.enrichment_signature(*a, "shape_code").alias("h8e"))


@query(rf"""WITH w AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents),
n AS (SELECT doc_id, replace(replace(w, '''', ''), ',', '.') AS s, w FROM w)
SELECT doc_id, count(*) AS words, count(CASE WHEN regexp_matches(s, {NUM}) THEN 1 END) AS numbers, round(sum(CASE WHEN regexp_matches(s, {NUM}) AND length(s) < 12 AND TRY_CAST(s AS DOUBLE) BETWEEN 0 AND 999999 THEN round(TRY_CAST(s AS DOUBLE), 4) END), 3) AS total FROM n GROUP BY doc_id""")
def h3_h5_numbers(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    n = C.number_cell("w")
    small = F.length(F.translate(F.translate("w", "'", ""), ",", ".")) < 12
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), F.count(n).alias("numbers"), F.round(F.sum(F.when(small, C.sanitize(n, 10, 4))), 3).alias("total"))


@query(r"""SELECT page_id, CASE WHEN s <> '' AND left(s, 1) NOT IN ('=', '#') THEN sha256(s) END AS h4, CASE WHEN trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&(nbsp|#160|#xA0|#32);', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) <> '' THEN true ELSE false END AS h22 FROM (SELECT page_id, html, trim(regexp_replace(html, '\s+', ' ', 'g')) AS s FROM pages)""")
def h4_h22_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(C.clean_text("html"), 256).alias("h4"), C.blank_after_markup("html").isNotNull().alias("h22"))


@query("SELECT row_no, sha1(concat_ws('|', lower(group_id), upper(serial_code), lower(item_id))) AS h9 FROM items", "items")
def h9_feed_hash(t: Tables) -> DataFrame:
    return t.items.select("row_no", C.feed_hash("group_id", "serial_code", "item_id").alias("h9"))


@query(r"""WITH h AS (SELECT p_partkey, regexp_replace(lower(concat(p_name, ' ', p_type)), '[^\p{L}\p{N}]+', '', 'g') AS k FROM part)
SELECT p_partkey, k AS h10, CASE WHEN regexp_matches(k, 'serialcode|serial|converterrefno|refno|зав|катал') THEN 'serial' WHEN regexp_matches(k, 'model|manufacturername|manufacturer|brand|произв|марка') THEN 'model' WHEN regexp_matches(k, 'piecekg|weightofcarrier|weight|тегло') THEN 'weight' WHEN regexp_matches(k, 'extracodes|additionalcodes|alternativecodes') THEN 'extra_codes' WHEN regexp_matches(k, 'details|additionaldescription|additionalinfo|description|доп|инф') THEN 'details' WHEN regexp_matches(k, 'shapecode|shape|formcode') THEN 'shape_code' WHEN contains(k, 'pt') THEN 'pt' WHEN contains(k, 'pd') THEN 'pd' WHEN contains(k, 'rh') THEN 'rh' END AS h11 FROM h""")
def h10_h11_headers(t: Tables) -> DataFrame:
    h = t.part.withColumn("h", F.concat_ws(" ", "p_name", "p_type"))
    return h.select("p_partkey", C.header_key("h").alias("h10"), C.header_role("h").alias("h11"))


@query(r"SELECT id, upper(trim(regexp_replace(regexp_replace(sheet_name, '^\s*new\s+', '', 'i'), '\s+', ' ', 'g'))) AS h13, trim(regexp_replace(regexp_replace(translate(lower(trim(sheet_name)), '_ ', '--'), '[^a-z0-9\-]+', '', 'g'), '-+', '-', 'g'), '-') AS h15 FROM groups", "groups")
def h13_h15_names(t: Tables) -> DataFrame:
    return t.groups.select("id", C.sheet_group_name("sheet_name").alias("h13"), C.slug("sheet_name").alias("h15"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path FROM pages),
q AS (SELECT page_id, path, regexp_extract(path, '(?:^|/)([^/]+)/[^/]*$', 1) AS seg FROM p)
SELECT page_id, path, CASE WHEN seg = '' THEN NULL ELSE nullif(regexp_replace(upper(regexp_replace(regexp_extract(path, '/([^/]+)', 1), '^\d+-', '')), '[^A-Z0-9]+', '', 'g'), '') END AS first_key FROM q""")
def h16_h17_url_parts(t: Tables) -> DataFrame:
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    seg = F.regexp_extract(path, r"(?:^|/)([^/]+)/[^/]*$", 1)
    first = F.regexp_extract(path, "/([^/]+)", 1)
    return t.pages.select("page_id", path.alias("path"), F.when(seg != "", C.product_key(F.concat(F.lit("/product/"), first))).alias("first_key"))


@query(r"""WITH f AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(concat(p_name, ' ; ', p_type, '/', upper(p_name), '|', p_brand), '[/;,|]'), lambda x: trim(x)), lambda x: x <> '') AS c FROM part)
SELECT p_partkey, array_to_string(list_filter(c, lambda x, i: NOT list_contains(list_transform(c[1:i - 1], lambda y: lower(y)), lower(x))), '#') AS codes FROM f""")
def h19_g1_split_codes(t: Tables) -> DataFrame:
    text = F.concat("p_name", F.lit(" ; "), "p_type", F.lit("/"), F.upper("p_name"), F.lit("|"), "p_brand")
    return t.part.select("p_partkey", F.array_join(C.split_codes(text), "#").alias("codes"))


@query(r"""WITH b AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN NULL ELSE concat(' item  ', CAST(page_id % 11 AS VARCHAR)) END AS a, CASE WHEN page_id % 2 = 0 THEN 'Metals Content' ELSE 'extra' END AS b FROM pages),
l AS (SELECT page_id, list_distinct(list_filter([trim(regexp_replace(a, '\s+', ' ', 'g')), url, b], lambda x: x IS NOT NULL AND NOT contains(lower(x), 'http://') AND NOT contains(lower(x), 'https://') AND lower(x) <> 'metals content')) AS v, url FROM b)
SELECT page_id, CASE WHEN len(v) = 0 THEN concat('page ', CAST(page_id AS VARCHAR)) ELSE array_to_string(list_sort(v), ' | ') END AS h20 FROM l""")
def h20_h21_details(t: Tables) -> DataFrame:
    a = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit(" item  "), (F.col("page_id") % 11).cast("string")))
    b = F.when(F.col("page_id") % 2 == 0, "Metals Content").otherwise("extra")
    # "extra" sorts before "item", so the order of the SQL's sorted list is the fields' order
    return t.pages.select("page_id", C.details_text(b, a, "url", F.array(a), F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("h20"))


@query("""WITH c AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS title_en, max(CASE WHEN turn = 1 THEN text END) AS body_en, max(CASE WHEN turn = 2 THEN text END) AS title_ar, max(CASE WHEN turn = 3 THEN text END) AS body_ar FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 2 = 1 AND title_ar IS NOT NULL AND body_ar IS NOT NULL THEN 'ar' ELSE 'en' END AS lang, sha256(trim(CASE WHEN conv_id % 2 = 1 AND title_ar IS NOT NULL AND body_ar IS NOT NULL THEN title_ar ELSE coalesce(title_en, '') END)) AS title FROM c""")
def h23_localized(t: Tables) -> DataFrame:
    pick = lambda n, name: F.max(F.when(F.col("turn") == n, F.col("text"))).alias(name)
    c = t.conversations.groupBy("conv_id").agg(pick(0, "title_en"), pick(1, "body_en"), pick(2, "title_ar"), pick(3, "body_ar"))
    asked = F.when(F.col("conv_id") % 2 == 1, "ar").otherwise("en")
    out = c.select("conv_id", C.localized(asked, {"en": ("title_en", "body_en"), "ar": ("title_ar", "body_ar")}).alias("r"))
    return out.select("conv_id", "r.lang", F.sha2("r.title", 256).alias("title"))


@query("""WITH v AS (SELECT user_id, lang, [CAST(user_id % 3 AS INTEGER), CAST(user_id % 11 AS INTEGER), 0, 0] AS cur FROM users)
SELECT user_id, CASE WHEN lang IN ('en', 'ar') THEN lang ELSE 'en' END AS h24, cur < [1, 0, 0, 0] AS required, cur < [2, 5, 0, 0] AS available FROM v""", "users")
def h24_h25_versions(t: Tables) -> DataFrame:
    current = F.concat_ws(".", (F.col("user_id") % 3).cast("string"), (F.col("user_id") % 11).cast("string"))
    out = t.users.select("user_id", C.known_or("lang", ["en", "ar"], "en").alias("h24"), C.update_state(current, F.lit("1.0.0"), F.lit("2.5.0")).alias("u"))
    return out.select("user_id", "h24", "u.required", "u.available")


@query("""SELECT row_no, CASE WHEN weight_kg > 50 THEN weight_kg / 1000 ELSE weight_kg END AS h26, CASE WHEN weight_kg IS NULL OR (weight_kg > 50 AND coalesce(pt_ppm > 0 AND pt_ppm <= 50, false)) THEN pt_ppm ELSE weight_kg END AS h28, source IS NULL AND ((pt_ppm > 0 AND pt_ppm < 100) OR (pd_ppm > 0 AND pd_ppm < 100) OR (rh_ppm > 0 AND rh_ppm < 100)) IS TRUE AS b19, coalesce(weight_kg > 50, false) AS b20 FROM items""", "items")
def b19_b20_h26_h28_weights(t: Tables) -> DataFrame:
    low = F.lit(False)
    for m in FIGURES[1:]:
        low = low | F.coalesce((F.col(m) > 0) & (F.col(m) < 100), F.lit(False))
    return t.items.select("row_no", C.weight_in_kg("weight_kg").alias("h26"), C.replaced_weight("weight_kg", "pt_ppm").alias("h28"), (F.col("source").isNull() & low).alias("b19"), F.coalesce(F.col("weight_kg") > 50, F.lit(False)).alias("b20"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS h29, round(price_oz, 2) AS price_oz, round(price_oz / 31.1035, 2) AS price_gram, CASE WHEN round(price_oz - 50, 2) > 0 THEN 'up' WHEN round(price_oz - 50, 2) < 0 THEN 'down' ELSE 'flat' END AS direction FROM quotes""", "quotes")
def h29_h30_quotes(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"data": '), "props", F.lit("}"))
    q = t.quotes.select("event_id", C.first_number(C.quote_node(body), ["$.bid", "$.k"]).alias("h29"), C.spot_row("price_oz", F.col("price_oz") - 50).alias("s"))
    return q.select("event_id", "h29", "s.price_oz", "s.price_gram", "s.direction")


@query("""WITH r AS (SELECT row_no, l AS v, CASE WHEN l > 1 AND l <= 100 THEN l / 100 ELSE l END AS p FROM (SELECT row_no, pt_ppm / 5 AS l FROM items WHERE pt_ppm IS NOT NULL))
SELECT row_no, round(p, 6) AS ratio, round(least(greatest(CASE WHEN p > 0 AND p <= 0.02 THEN p * 100 ELSE p END, 0), 1), 6) AS recovery, round(least(greatest(v, 0), 100) / 100, 6) AS clamped FROM r""", "items")
def h31_h32_rates(t: Tables) -> DataFrame:
    v = F.col("pt_ppm") / 5
    return t.items.filter("pt_ppm IS NOT NULL").select("row_no", F.round(C.ratio(v), 6).alias("ratio"), F.round(C.recovery_rate(v), 6).alias("recovery"), F.round(C.clamped_rate(v), 6).alias("clamped"))


@query("SELECT item_id, CAST(row_number() OVER (ORDER BY created_at DESC, item_id) AS BIGINT) - 1 AS position, printf('Pt %.2f%%, Pd %.2f%%, Rh %.2f%%', pt_ppm, pd_ppm, rh_ppm) AS body FROM items WHERE pt_ppm IS NOT NULL AND pd_ppm IS NOT NULL AND rh_ppm IS NOT NULL", "items")
def e13_h33_newest_notes(t: Tables) -> DataFrame:
    """Positions over the whole table, newest first."""
    some = t.items.filter("pt_ppm IS NOT NULL AND pd_ppm IS NOT NULL AND rh_ppm IS NOT NULL").select("created_at", "item_id", "pt_ppm", "pd_ppm", "rh_ppm")
    placed = rank.ranked(some, [("created_at", True), ("item_id", False)])
    return placed.select("item_id", "position", C.change_text("pt_ppm", "pd_ppm", "rh_ppm").alias("body"))


ISSUE = f"CASE WHEN trim(coalesce(serial_code, '')) = '' THEN 'missing_serial_code' WHEN contains(upper(serial_code), 'KONTROLINIS') THEN 'control_row' WHEN NOT {USABLE} THEN 'invalid_serial_code' WHEN trim(coalesce(model, '')) = '' THEN 'missing_model' WHEN coalesce(weight_kg, 0) <= 0 THEN 'missing_or_invalid_weight' WHEN NOT {METAL} THEN 'missing_assay_values' END"


@query(f"SELECT row_no, {PRICEABLE} AS b1, {USABLE} AS b6, trim(coalesce(CAST(weight_kg AS VARCHAR), shape_code, details, '')) <> '' AS b8, {ISSUE} AS b9, {USABLE} AND trim(coalesce(model, '')) <> '' AND coalesce(weight_kg, 0) > 0 AND {METAL} AS b11, {USABLE} AND trim(coalesce(model, '')) <> '' AND (weight_kg IS NOT NULL OR pt_ppm IS NOT NULL OR shape_code IS NOT NULL) AS b12 FROM items", "items")
def b1_b6_b8_b9_b11_b12_rows(t: Tables) -> DataFrame:
    a = ("serial_code", "model", *FIGURES)
    return t.items.select("row_no", Q.priceable().alias("b1"), C.usable_serial("serial_code").alias("b6"), Q.has_data("weight_kg", "shape_code", "details").alias("b8"), Q.issue_code(*a).alias("b9"), Q.valid_row(*a).alias("b11"), Q.enrichable("serial_code", "model", "weight_kg", "pt_ppm", "shape_code").alias("b12"))


@query(r"""WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '100/200' WHEN 1 THEN ' 12,5' WHEN 2 THEN '=A1' WHEN 3 THEN '10 - 20' WHEN 4 THEN p_type ELSE '' END AS raw FROM part),
v AS (SELECT *, trim(raw) AS r, replace(replace(replace(raw, ' ', ''), '''', ''), ',', '.') AS n FROM r)
SELECT p_partkey, r <> '' AND left(r, 1) NOT IN ('=', '#') AND NOT regexp_matches(n, """ + NUM + r""") AS b10 FROM v""")
def b10_ambiguous_assay(t: Tables) -> DataFrame:
    raw = F.element_at(F.array(F.lit("100/200"), F.lit(" 12,5"), F.lit("=A1"), F.lit("10 - 20"), F.col("p_type"), F.lit("")), (F.col("p_partkey") % 6).cast("int") + 1)
    return t.part.select("p_partkey", Q.ambiguous_assay(raw, C.number_cell(raw)).alias("b10"))


@query("SELECT page_id, contains(lower(url), '/item') OR contains(lower(url), 'no-image') OR NOT regexp_matches(lower(url), '^https?://') AS b7, CASE WHEN page_id % 5 = 0 THEN 'Missing brand_page_url.' WHEN page_id % 7 = 0 THEN 'Unable to extract a valid brand slug.' WHEN page_id % 11 = 0 THEN 'Missing product_name.' END AS b13 FROM pages")
def b7_b13_feed_records(t: Tables) -> DataFrame:
    unless = lambda n: F.when(F.col("page_id") % n != 0, F.lit("some-thing"))
    return t.pages.select("page_id", Q.rejected_image("url", ["/item", "no-image"]).alias("b7"), Q.feed_issue(unless(5), C.slug(unless(7)), "url", "url", unless(11), F.lit("x")).alias("b13"))


@query(f"SELECT item_id FROM items WHERE {PRICEABLE} AND item_id IN (SELECT item_id FROM media WHERE flag = 'R')", "items", "media")
def b2_visible(t: Tables) -> DataFrame:
    return search.visible(t.items, t.media.filter("flag = 'R'")).select("item_id")


@query(rf"SELECT item_id FROM items i WHERE contains(lower(serial_code), 'kt-11') OR contains(lower(model), 'kt-11') OR contains({ns('serial_code')}, 'KT11') OR EXISTS (SELECT 1 FROM codes c WHERE c.item_id = i.item_id AND (contains(lower(code), 'kt-11') OR contains({ns('code')}, 'KT11')))", "items", "codes")
def b3_c17_text_search(t: Tables) -> DataFrame:
    return search.text_search(t.items, t.codes, "kt-11").select("item_id")


@query("SELECT item_id FROM items WHERE model = 'Model 3' AND group_id IN (SELECT id FROM groups WHERE contains(lower(name), 'on_1') OR contains(lower(sheet_name), 'on_1')) AND item_id NOT IN (SELECT item_id FROM media WHERE flag = 'R')", "items", "groups", "media")
def b4_b5_b15_filters(t: Tables) -> DataFrame:
    some = search.group_filter(t.items.filter(F.col("model") == "Model 3"), t.groups, "on_1")
    return search.with_image(some, t.media.filter("flag = 'R'"), False).select("item_id")


@query("SELECT user_id FROM users u WHERE is_active AND segment IN ('BUILDING', 'MACHINERY') AND NOT EXISTS (SELECT 1 FROM roles r WHERE r.user_id = u.user_id AND k <> 3 AND role = 'admin') AND (NOT EXISTS (SELECT 1 FROM roles r WHERE r.user_id = u.user_id AND k <> 3) OR EXISTS (SELECT 1 FROM roles r WHERE r.user_id = u.user_id AND k <> 3 AND role = 'app_user')) AND user_id IN (SELECT user_id FROM saved)", "users", "roles", "saved")
def b16_b17_c27_recipients(t: Tables) -> DataFrame:
    people = t.users.filter(F.col("segment").isin("BUILDING", "MACHINERY"))
    return search.recipients(people, t.roles.filter("k <> 3"), t.saved).select("user_id")


@query("SELECT media_id FROM (SELECT media_id, item_id, CASE WHEN media_id % 2 = 0 THEN 'original' ELSE 'thumb' END AS variant, concat('x+pixel_', CASE WHEN media_id % 3 = 0 THEN 'mask' ELSE 'none' END) AS method, CAST((media_id % 50) / 100 AS DOUBLE) AS score FROM media) WHERE variant = 'original' AND contains(method, 'pixel_mask') AND score >= 0.12 AND item_id IN (SELECT item_id FROM items WHERE " + PRICEABLE + ")", "items", "media")
def b18_image_issues(t: Tables) -> DataFrame:
    m = t.media.select("media_id", "item_id", F.when(F.col("media_id") % 2 == 0, "original").otherwise("thumb").alias("variant"), F.concat(F.lit("x+pixel_"), F.when(F.col("media_id") % 3 == 0, "mask").otherwise("none")).alias("method"), ((F.col("media_id") % 50) / 100).cast("string").alias("score"))
    return m.filter(Q.image_issue("variant", "method", "score")).join(t.items.filter(Q.priceable()).select("item_id"), "item_id", "left_semi").select("media_id")


@query(f"SELECT row_no, {ISSUE} AS issue FROM items WHERE {ISSUE} IN ('control_row', 'missing_model') ORDER BY row_no DESC LIMIT 200", "items")
def b24_issue_listing(t: Tables) -> DataFrame:
    rows = t.items.select("row_no", Q.issue_code("serial_code", "model", *FIGURES).alias("issue"))
    return rows.filter(F.col("issue").isin("control_row", "missing_model")).orderBy(F.desc("row_no")).limit(200)


@query("SELECT event_id, price_oz FROM quotes WHERE key IN ('pt', 'rh')", "quotes")
def b21_metal_subset(t: Tables) -> DataFrame:
    return t.quotes.filter(F.col("key").isin("pt", "rh")).select("event_id", "price_oz")


@query("WITH c AS (SELECT item_id, array_to_string(list_sort(list_distinct(list(code))), ',') AS codes FROM codes GROUP BY item_id) SELECT i.item_id, name AS group_name, coalesce(codes, '') AS codes, i.item_id IN (SELECT item_id FROM saved WHERE user_id = 7) AS is_saved FROM items i LEFT JOIN groups g ON g.id = i.group_id LEFT JOIN c ON c.item_id = i.item_id", "items", "groups", "codes", "saved")
def b23_c1_c3_embedded(t: Tables) -> DataFrame:
    rows = search.saved_flag(search.embedded(t.items, t.groups, t.codes), t.saved, 7)
    return rows.select("item_id", "group_name", F.array_join("codes", ",").alias("codes"), "is_saved")


@query(f"SELECT id, name FROM groups WHERE id IN (SELECT group_id FROM items WHERE {PRICEABLE} AND item_id IN (SELECT item_id FROM media WHERE flag = 'R')) ORDER BY name", "items", "groups", "media")
def c2_visible_groups(t: Tables) -> DataFrame:
    return search.visible_groups(t.groups, t.items, t.media.filter("flag = 'R'")).select("id", "name")


@query(f"WITH r AS (SELECT row_no, group_id, {ns('serial_code')} AS k FROM items WHERE source IS NULL AND {ns('serial_code')} LIKE 'KT%'), k AS (SELECT DISTINCT group_id, row_no AS item_no, unnest([{ns('serial_code')}, translate(upper(coalesce(serial_code, '')), ' -/.', '')]) AS k FROM items WHERE source IS NOT NULL) SELECT row_no, count(DISTINCT item_no) AS n FROM r JOIN k USING (group_id, k) GROUP BY row_no", "items")
def c4_same_serial(t: Tables) -> DataFrame:
    rows = t.items.filter(F.col("source").isNull() & C.normalize_serial("serial_code").startswith("KT"))
    return dedupe.same_serial(rows, t.items.filter("source IS NOT NULL")).groupBy("row_no").agg(F.count("*").alias("n"))


@query(f"SELECT row_no FROM items WHERE source IS NULL AND {SIG} NOT IN (SELECT {SIG} FROM items WHERE source IS NOT NULL)", "items")
def c5_known_assays(t: Tables) -> DataFrame:
    return dedupe.without_known_assays(t.items.filter("source IS NULL"), t.items.filter("source IS NOT NULL")).select("row_no")


CANDIDATES = """r AS (SELECT * FROM items WHERE source IS NULL), p AS (SELECT r.row_no, i.row_no AS item_no, CASE WHEN r.details IS NULL OR coalesce(r.details = i.details, false) THEN 0 ELSE 1 END AS tier FROM r JOIN items i ON r.group_id = i.group_id AND upper(trim(coalesce(r.model, ''))) = upper(coalesce(i.model, '')) AND i.source = 'A' WHERE (r.weight_kg IS NULL OR r.weight_kg = i.weight_kg) AND (r.pt_ppm IS NULL OR r.pt_ppm = i.pt_ppm) AND (trim(coalesce(r.shape_code, '')) = '' OR upper(trim(r.shape_code)) = upper(coalesce(i.shape_code, '')))),
b AS (SELECT row_no, item_no FROM p QUALIFY tier = min(tier) OVER (PARTITION BY row_no)),
h AS (SELECT r.row_no, count(DISTINCT item_no) AS n, CASE WHEN count(DISTINCT item_no) = 1 THEN min(item_no) END AS item_no FROM r LEFT JOIN b ON b.row_no = r.row_no GROUP BY r.row_no)"""


@query(f"WITH {CANDIDATES} SELECT * FROM h", "items")
def c6_repair_candidates(t: Tables) -> DataFrame:
    return match.repair_candidates(t.items.filter("source IS NULL"), t.items.filter("source = 'A'"), ["weight_kg", "pt_ppm", "shape_code"])


@query(f"WITH f AS (SELECT row_no, {FP} AS fp FROM items) SELECT row_no, coalesce((SELECT count(*) FROM f g WHERE g.fp = f.fp AND g.row_no <> f.row_no) > 0, false) AS collides FROM f", "items")
def c7_collisions(t: Tables) -> DataFrame:
    fp = C.fingerprint("group_id", "serial_code", *FIGURES)
    return dedupe.collisions(t.items.select("row_no", fp.alias("new_fingerprint")), t.items.select("row_no", fp.alias("assay_fingerprint"))).select("row_no", "collides")


@query(f"""WITH f AS (SELECT row_no, item_id, slot, source, {FP} AS h FROM items), l AS (SELECT row_no, slot AS url, h FROM f WHERE source IS NULL), r AS (SELECT slot + slot % 2 AS url, h, item_id AS id FROM f WHERE source IS NOT NULL),
m AS (SELECT row_no, 0 AS tier, id FROM l JOIN r USING (url) UNION ALL SELECT l.row_no, 1, id FROM l JOIN r ON l.h = r.h),
b AS (SELECT row_no, id FROM m QUALIFY tier = min(tier) OVER (PARTITION BY row_no))
SELECT l.row_no, count(DISTINCT id) AS n, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id FROM l LEFT JOIN b ON b.row_no = l.row_no GROUP BY l.row_no""", "items")
def c8_c9_c13_tiered_lookup(t: Tables) -> DataFrame:
    hashed = t.items.withColumn("h", C.fingerprint("group_id", "serial_code", *FIGURES))
    left = hashed.filter("source IS NULL").select("row_no", F.col("slot").alias("url"), "h")
    right = hashed.filter("source IS NOT NULL").select((F.col("slot") + F.col("slot") % 2).alias("url"), "h", F.col("item_id").alias("id"))
    return match.tiered(left, right, "row_no", [("url", "url"), ("h", "h")], "id")


@query("SELECT s_suppkey, concat('g', CAST(min(n_nationkey) AS VARCHAR)) AS group_id FROM (SELECT s_suppkey, s_nationkey FROM supplier) LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY s_suppkey")
def c10_c11_c12_group_names(t: Tables) -> DataFrame:
    sheets = t.supplier.join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey").select("s_suppkey", F.concat(F.lit("NEW  "), F.lower("n_name")).alias("sheet"))
    return match.group_of_name(sheets, t.groups).select("s_suppkey", "group_id")


WANTED = "w AS (SELECT DISTINCT concat(group_id, '|', k) AS wanted_id, group_id, k FROM (SELECT group_id, concat('ALT', CAST(row_no % 90 AS VARCHAR)) AS k FROM items))"


@query(f"WITH {WANTED}, k AS (SELECT item_id, group_id, {ns('serial_code')} AS k FROM items UNION SELECT c.item_id, group_id, {ns('code')} FROM codes c JOIN items i ON i.item_id = c.item_id) SELECT wanted_id, count(*) AS n, min(item_id) AS first_item FROM (SELECT DISTINCT wanted_id, item_id FROM w JOIN k USING (group_id, k)) GROUP BY wanted_id", "items", "codes")
def c14_family_join(t: Tables) -> DataFrame:
    hits = match.family_join(t.items, t.codes, _wanted(t))
    return hits.groupBy("wanted_id").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"))


def _wanted(t: Tables) -> DataFrame:
    serial = F.concat(F.lit("ALT"), (F.col("row_no") % 90).cast("string"))
    return t.items.select(F.concat_ws("|", "group_id", serial).alias("wanted_id"), "group_id", serial.alias("serial")).distinct()


@query(f"WITH {WANTED}, k AS (SELECT DISTINCT item_id, k FROM (SELECT item_id, {ns('serial_code')} AS k FROM items UNION ALL SELECT item_id, {ns('code')} FROM codes) WHERE k <> ''), c AS (SELECT k, count(*) AS n FROM k GROUP BY k) SELECT wanted_id, n FROM w JOIN c USING (k)", "items", "codes")
def c15_g5_cross_group_join(t: Tables) -> DataFrame:
    return match.family_counts(t.items, t.codes, _wanted(t).drop("group_id"), None)


@query("""WITH i AS (SELECT p_partkey AS item_id, p_brand AS brand_key, string_split(p_name, ' ') AS t FROM part), c AS (SELECT n_nationkey AS group_id, concat('Brand#', CAST(n_nationkey AS VARCHAR)) AS key, [lower(n_name), concat('x', CAST(n_nationkey AS VARCHAR))] AS t FROM nation),
s AS (SELECT item_id, group_id, 3 AS score FROM i JOIN c ON brand_key = key UNION ALL SELECT DISTINCT item_id, group_id, 1 FROM (SELECT item_id, unnest(t) AS w FROM i) JOIN (SELECT group_id, unnest(t) AS w FROM c) USING (w)),
b AS (SELECT item_id, group_id FROM s QUALIFY score = max(score) OVER (PARTITION BY item_id)), f AS (SELECT item_id, min(group_id) AS g FROM b GROUP BY item_id HAVING count(DISTINCT group_id) = 1)
SELECT i.item_id, coalesce(g, -1) AS group_id FROM i LEFT JOIN f USING (item_id)""")
def c16_c24_j7_categories(t: Tables) -> DataFrame:
    items = t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("brand_key"), F.split("p_name", " ").alias("tokens"))
    cats = t.nation.select(F.col("n_nationkey").alias("group_id"), F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("key"), F.array(F.lower("n_name"), F.concat(F.lit("x"), F.col("n_nationkey").cast("string"))).alias("tokens"))
    return jobs.link_categories(items, cats, -1).select("item_id", "group_id")


@query(f"""WITH k AS (SELECT DISTINCT item_id, k FROM (SELECT item_id, {ns('serial_code')} AS k FROM items UNION ALL SELECT i.item_id, {ns('code')} FROM codes c JOIN items i ON i.item_id = c.item_id) WHERE k <> ''),
s AS (SELECT media_id, item_id, k FROM media JOIN k USING (item_id) WHERE flag = 'R')
SELECT k.item_id, min(media_id) AS media_id FROM k JOIN (SELECT k, min(media_id) AS media_id FROM s GROUP BY k) m USING (k) WHERE k.item_id NOT IN (SELECT item_id FROM s) GROUP BY k.item_id""", "items", "codes", "media")
def c18_c19_propagate(t: Tables) -> DataFrame:
    return match.propagate_by_codes(t.items, t.codes, t.media.filter("flag = 'R'"))


@query(f"""WITH i AS (SELECT item_id, group_id, {ns('serial_code')} AS k, created_at, item_id IN (SELECT item_id FROM media WHERE flag = 'R') AS h FROM items WHERE {PRICEABLE} AND {ns('serial_code')} <> ''), s AS (SELECT group_id, k, arg_min(item_id, struct_pack(a := created_at, b := item_id)) AS source_id FROM i WHERE h GROUP BY group_id, k)
SELECT item_id, source_id FROM i JOIN s USING (group_id, k) WHERE NOT h""", "items", "media")
def c20_e7_j11_siblings(t: Tables) -> DataFrame:
    return jobs.sibling_images(t.items, t.media.filter("flag = 'R'"))


@query("WITH m AS (SELECT min(item_id) AS id FROM items) SELECT item_id FROM (SELECT item_id, created_at FROM items WHERE group_id IN (SELECT group_id FROM items WHERE item_id = (SELECT id FROM m)) AND item_id <> (SELECT id FROM m) ORDER BY created_at DESC, item_id LIMIT 6)", "items")
def c23_f3_related(t: Tables) -> DataFrame:
    """Others of the group of one item, here the first."""
    return search.related(t.items, t.items.agg(F.min("item_id")).first()[0]).select("item_id")


@query(f"SELECT item_id FROM (SELECT item_id, created_at FROM items WHERE {PRICEABLE} AND item_id IN (SELECT item_id FROM media WHERE flag = 'R') ORDER BY created_at DESC, item_id LIMIT 6)", "items", "media")
def f3_newest_visible(t: Tables) -> DataFrame:
    return search.newest_visible(t.items, t.media.filter("flag = 'R'")).select("item_id")


@query(f"""WITH f AS (SELECT concat_ws('|', group_id, s) AS family, concat(group_id, s) AS key FROM (SELECT DISTINCT group_id, {ns('serial_code')} AS s FROM items WHERE {USABLE}) UNION SELECT concat_ws('|', group_id, s), s FROM (SELECT DISTINCT group_id, {ns('serial_code')} AS s FROM items WHERE {USABLE})),
k AS (SELECT concat('KT', CAST(p_partkey AS VARCHAR)) AS key FROM part WHERE p_size > 10 UNION SELECT concat('g', CAST(p_partkey % 25 AS VARCHAR), 'KT', CAST(p_partkey AS VARCHAR)) FROM part)
SELECT key, min(family) AS family FROM f WHERE key IN (SELECT key FROM k) GROUP BY key HAVING count(DISTINCT family) = 1""", "items")
def c25_coverage(t: Tables) -> DataFrame:
    """Families go by their serial and by group and serial; only keys of one family cover it."""
    fam = t.items.filter(C.usable_serial("serial_code")).select("group_id", C.normalize_serial("serial_code").alias("s")).distinct()
    number = F.col("p_partkey").cast("string")
    keys = t.part.filter("p_size > 10").select(F.concat(F.lit("KT"), number).alias("key")).unionByName(t.part.select(F.concat(F.lit("g"), (F.col("p_partkey") % 25).cast("string"), F.lit("KT"), number).alias("key")))
    return match.covered_families(fam.select(F.concat_ws("|", "group_id", "s").alias("family"), F.array("s", F.concat("group_id", "s")).alias("keys")), keys).select("key", "family")


@query("""WITH r AS (SELECT row_no AS id, concat(group_id, shape_code) AS hash FROM items WHERE shape_code IS NOT NULL AND source IS NULL) SELECT id FROM r WHERE id IN (SELECT row_no FROM items WHERE model = 'Model 2') AND id NOT IN (SELECT row_no FROM items WHERE pd_ppm IS NULL) AND hash NOT IN (SELECT concat(group_id, shape_code) FROM items WHERE shape_code IS NOT NULL AND source IS NOT NULL AND weight_kg > 4900)""", "items")
def c26_unprocessed(t: Tables) -> DataFrame:
    hashed = t.items.withColumn("hash", F.concat("group_id", "shape_code"))
    none = F.lit(None)
    done = t.items.filter("pd_ppm IS NULL").select(F.col("row_no").alias("id"), none.cast("string").alias("hash")).unionByName(hashed.filter("source IS NOT NULL AND weight_kg > 4900").select(none.cast("long").alias("id"), "hash"))
    return match.unprocessed(hashed.filter("hash IS NOT NULL AND source IS NULL").select(F.col("row_no").alias("id"), "hash"), done, t.items.filter("model = 'Model 2'").select(F.col("row_no").alias("id"))).select("id")


def _phash(column: str = "embedding"):
    return F.aggregate(F.transform(column, lambda x, k: F.when((x > 0) & (k < 63), F.expr("1L").bitwiseOR(0) * F.pow(F.lit(2.0), k).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)


PHASH = "h AS (SELECT vec_id, label, embedding, list_sum(list_transform(embedding[1:63], lambda x, i: CASE WHEN x > 0 THEN CAST(pow(2, i - 1) AS HUGEINT) ELSE 0::HUGEINT END))::BIGINT AS phash FROM embeddings)"


@query(f"WITH {PHASH}, r AS (SELECT DISTINCT phash FROM h WHERE label % 5 = 0) SELECT vec_id, CAST((SELECT min(bit_count(xor(h.phash, r.phash))) FROM r) AS BIGINT) AS distance FROM h")
def c28_nearest_references(t: Tables) -> DataFrame:
    """Every image against the images of two labels, near and far."""
    h = t.embeddings.select("vec_id", "label", _phash().alias("phash"))
    return hamming.nearest_hash(h, h.filter("label % 5 = 0")).select("vec_id", "distance")


@query(f"""WITH {PHASH}, d AS (SELECT vec_id, label % 3 AS f, 20 + 3 * label AS c, 10 + 2 * label AS s, CAST(abs(embedding[1]) AS DOUBLE) AS m, (SELECT min(bit_count(xor(h.phash, r.phash))) FROM h r WHERE r.label = 7) AS d FROM h),
v AS (SELECT *, CASE WHEN d <= 4 THEN 'spam_hash' WHEN f > 0 AND c >= 35 AND s >= 18 THEN 'spam_face' WHEN m >= 0.15 AND c >= 20 THEN 'wrong_mark' END AS verdict FROM d)
SELECT vec_id AS media_id, verdict, CASE verdict WHEN 'spam_hash' THEN round(1 - d / 64, 4) WHEN 'spam_face' THEN round(least(1.0, 0.4 + 0.1 * f + c / 100), 4) ELSE round(m, 4) END AS score FROM v WHERE verdict IS NOT NULL""")
def b25_c28_j15_media_audit(t: Tables) -> DataFrame:
    """The audit over features of all images; those of one label are known spam."""
    label = F.col("label")
    f = t.embeddings.select(F.col("vec_id").alias("media_id"), "label", _phash().alias("phash"), (label % 3).alias("face_count"), (20 + 3 * label).cast("double").alias("colorfulness"), (10 + 2 * label).cast("double").alias("mean_saturation"), F.abs(F.col("embedding")[0]).cast("double").alias("match_score"))
    return jobs.media_audit(f, f.filter("label = 7"))


@query("SELECT vec_id, s[1] >= 0.82 OR (s[1] >= 0.67 AND s[2] >= 0.62) AS marked FROM (SELECT vec_id, list_reverse_sort(list_transform(embedding, lambda x: CAST(abs(x) * 2 AS DOUBLE))) AS s FROM embeddings)")
def b26_marks(t: Tables) -> DataFrame:
    scores = F.transform("embedding", lambda x: (F.abs(x) * 2).cast("double"))
    return t.embeddings.select("vec_id", Q.marked(scores).alias("marked"))


@query(f"""WITH f AS (SELECT row_no AS item_id, source, {fp_of(HELD)} AS fp, {fp_of(HELD + " * 1000")} AS new_fp, {fp_of("{0} / 1000")} AS raw_fp FROM items)
SELECT count(*) AS matched, count(CASE WHEN v THEN 1 END) AS verified, count(CASE WHEN NOT v THEN 1 END) AS unverified, count(CASE WHEN v AND c THEN 1 END) AS collision, count(CASE WHEN v AND NOT c THEN 1 END) AS updated FROM (SELECT coalesce(fp IN (SELECT raw_fp FROM f WHERE source IS NOT NULL AND raw_fp IS NOT NULL), false) AS v, coalesce((SELECT count(*) FROM f g WHERE g.fp = f.new_fp AND g.item_id <> f.item_id) > 0, false) AS c FROM f)""", "items")
def c29_d22_j10_legacy(t: Tables) -> DataFrame:
    """Slots divisible by three hold ppm already; the other items, and the source, hold grams in a kilogram."""
    fp = lambda form: C.fingerprint("group_id", "serial_code", "weight_kg", *(form(F.col(m)) for m in FIGURES[1:]))
    held = lambda c: F.when(F.col("slot") % 3 == 0, c).otherwise(c / 1000)
    raw = F.when(F.col("source").isNotNull(), fp(lambda c: c / 1000))
    # written once: three sides of the joins go by it
    hashed = saved(t.items.select(F.col("row_no").alias("item_id"), fp(held).alias("fp"), fp(lambda c: C.grams_in_ppm(held(c))).alias("new_fp"), raw.alias("raw_fp")))
    return jobs.convert_legacy(hashed.drop("raw_fp"), hashed.filter("raw_fp IS NOT NULL").select("raw_fp"))


@query("""WITH i AS (SELECT item_id AS id, group_id, model AS value FROM items), r AS (SELECT concat('n', CAST(row_no AS VARCHAR)) AS review_id, item_id AS existing_id, CASE row_no % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'overwrite' ELSE 'insert' END AS decision, shape_code AS value FROM items WHERE source IS NOT NULL)
SELECT i.id, group_id, coalesce(r.value, i.value) AS value FROM i LEFT JOIN r ON existing_id = i.id AND decision = 'overwrite' UNION ALL SELECT review_id, group_id, r.value FROM r JOIN i ON existing_id = i.id WHERE decision = 'insert'""", "items")
def c30_j14_reviews(t: Tables) -> DataFrame:
    items = t.items.select(F.col("item_id").alias("id"), "group_id", F.col("model").alias("value"))
    decision = F.when(F.col("row_no") % 3 == 0, "keep").when(F.col("row_no") % 3 == 1, "overwrite").otherwise("insert")
    reviews = t.items.filter("source IS NOT NULL").select(F.concat(F.lit("n"), F.col("row_no").cast("string")).alias("review_id"), F.col("item_id").alias("existing_id"), decision.alias("decision"), F.col("shape_code").alias("value"))
    return jobs.resolve_reviews(items, reviews)


@query(f"SELECT group_id AS file, count(CASE WHEN o = 'inserted' THEN 1 END) AS inserted, count(CASE WHEN o = 'skipped' THEN 1 END) AS skipped, count(CASE WHEN o = 'invalid' THEN 1 END) AS invalid FROM (SELECT group_id, CASE WHEN issue IS NOT NULL THEN 'invalid' WHEN n > 1 OR sig IN (SELECT {SIG} FROM items WHERE source IS NOT NULL) THEN 'skipped' ELSE 'inserted' END AS o FROM (SELECT group_id, {ISSUE} AS issue, {SIG} AS sig, row_number() OVER (PARTITION BY group_id, {SIG}, {ISSUE} IS NULL ORDER BY row_no) AS n FROM items WHERE source IS NULL)) GROUP BY group_id", "items")
def d1_d3_e1_j2_import_report(t: Tables) -> DataFrame:
    rows = t.items.filter("source IS NULL").withColumn("file", F.col("group_id"))
    done = jobs.classified(rows, t.items.filter("source IS NOT NULL"), ["row_no"])
    return report.outcome_counts(done, ["inserted", "skipped", "invalid"], "file")


@query("SELECT id, (SELECT count(*) FROM items i WHERE i.group_id = g.id) AS items, (SELECT count(*) FROM supplier s WHERE concat('g', CAST(s_nationkey AS VARCHAR)) = g.id AND s_acctbal < 0) AS children FROM groups g", "items", "groups")
def d4_d11_d12_children(t: Tables) -> DataFrame:
    sup = t.supplier.filter("s_acctbal < 0").select(F.concat(F.lit("g"), F.col("s_nationkey").cast("string")).alias("id"))
    return report.children_counts(t.groups.select("id"), "id", items=t.items.select(F.col("group_id").alias("id")), children=sup)


@query(f"SELECT count(*) AS families, count(CASE WHEN a > 1 THEN 1 END) AS multi, CAST(sum(n - a) AS BIGINT) AS duplicates FROM (SELECT group_id, {ns('serial_code')} AS s, count(*) AS n, count(DISTINCT {ASSAY}) AS a FROM items GROUP BY ALL)", "items")
def d5_d6_families(t: Tables) -> DataFrame:
    return report.families(t.items)


@query(f"SELECT s, count(DISTINCT group_id) AS n, array_to_string(list_sort(list_distinct(list(group_id))), '|') AS targets FROM (SELECT {ns('serial_code')} AS s, group_id FROM items) GROUP BY s HAVING count(DISTINCT group_id) > 1", "items")
def d7_a7_ambiguous(t: Tables) -> DataFrame:
    return report.ambiguous(t.items.select(C.normalize_serial("serial_code").alias("s"), "group_id"), "s", "group_id")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS items, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS copies FROM (SELECT count(*) AS n FROM items GROUP BY group_id, {ns('serial_code')})", "items")
def d8_copies(t: Tables) -> DataFrame:
    return report.copies(t.items.groupBy("group_id", C.normalize_serial("serial_code")).agg(F.count("*").alias("n")))


@query("SELECT coalesce(source, '') AS source, coalesce(shape_code, '') AS shape_code, count(*) AS n FROM items GROUP BY 1, 2 HAVING count(*) > 1", "items")
def d9_duplicate_keys(t: Tables) -> DataFrame:
    return dedupe.duplicate_keys(t.items, "source", "shape_code")


@query(f"SELECT fp AS assay_fingerprint, count(*) AS n FROM (SELECT {FP} AS fp FROM items) WHERE fp IS NOT NULL GROUP BY fp HAVING count(*) > 1", "items")
def d10_duplicate_fingerprints(t: Tables) -> DataFrame:
    return jobs.backfill_fingerprints(t.items)["duplicates"]


@query(f"SELECT item_id, CASE WHEN row_number() OVER (PARTITION BY fp ORDER BY created_at, item_id) = 1 THEN fp END AS assay_fingerprint FROM (SELECT item_id, created_at, {FP} AS fp FROM items)", "items")
def e4_j12_unique_fingerprints(t: Tables) -> DataFrame:
    return jobs.backfill_fingerprints(t.items)["items"].select("item_id", "assay_fingerprint")


@query("SELECT (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM users WHERE is_active) AS users, (SELECT count(*) FROM saved) AS saved, (SELECT count(*) FROM supplier WHERE s_acctbal >= 0) AS sent_campaigns, (SELECT arg_max(price_oz, struct_pack(a := \"at\", e := event_id)) FROM quotes WHERE key = 'pt') AS latest_pt", "items", "users", "saved", "quotes")
def d13_kpis(t: Tables) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    campaigns = t.supplier.select("s_suppkey", F.when(F.col("s_acctbal") >= 0, "sent").otherwise("draft").alias("status"))
    pt = price.latest(t.quotes.filter("key = 'pt'"), "at", "event_id", "price_oz").select(F.col("price_oz").alias("latest_pt"))
    return n(t.items, "items").crossJoin(n(t.users.filter("is_active"), "users")).crossJoin(n(t.saved, "saved")).crossJoin(n(campaigns.filter("status = 'sent'"), "sent_campaigns")).crossJoin(pt)


@query("SELECT DISTINCT region FROM groups WHERE region <> '' ORDER BY region", "groups")
def d14_regions(t: Tables) -> DataFrame:
    return t.groups.filter("region <> ''").select("region").distinct().orderBy("region")


@query("SELECT user_id, count(CASE WHEN key = 'error' THEN 1 END) AS unread FROM quotes GROUP BY user_id", "quotes")
def d15_unread(t: Tables) -> DataFrame:
    return t.quotes.groupBy("user_id").agg(F.count_if(F.col("key") == "error").alias("unread"))


@query("SELECT snap, count(DISTINCT CASE WHEN price_oz > 0 AND key IN ('pt', 'pd', 'rh') THEN key END) = 3 AS complete FROM quotes GROUP BY snap", "quotes")
def d16_complete_snapshots(t: Tables) -> DataFrame:
    return price.complete_snapshots(t.quotes, "snap")


@query("SELECT key AS status, count(*) AS n FROM quotes GROUP BY key", "quotes")
def d20_status(t: Tables) -> DataFrame:
    return report.histogram(t.quotes, "key")


@query("SELECT user_id % 50 AS campaign, count(*) AS total_recipients, count(CASE WHEN key IN ('pt', 'pd') THEN 1 END) AS delivered_count, count(CASE WHEN key = 'rh' THEN 1 END) AS failed_count FROM quotes GROUP BY 1", "quotes")
def d19_deliveries(t: Tables) -> DataFrame:
    status = F.when(F.col("key").isin("pt", "pd"), "sent").when(F.col("key") == "rh", "failed").otherwise("pending")
    return report.deliveries(t.quotes.select((F.col("user_id") % 50).alias("campaign"), status.alias("status")))


@query(f"SELECT count(*) AS rows_total, count(*) - count({ISSUE}) AS rows_valid, count({ISSUE}) AS rows_invalid, count(CASE WHEN {ISSUE} IS NULL AND source IS NULL THEN 1 END) AS products_created, count(CASE WHEN {ISSUE} IS NULL AND source = 'A' THEN 1 END) AS products_updated, count(CASE WHEN {ISSUE} IS NULL AND source = 'R' THEN 1 END) AS products_skipped, array_to_string(list_sort(list_distinct(list({ISSUE}))), '|') AS failure_messages FROM items", "items")
def d18_feed_summary(t: Tables) -> DataFrame:
    rows = t.items.select(Q.issue_code("serial_code", "model", *FIGURES).alias("issue"), "source")
    outcome = F.when(F.col("issue").isNotNull(), "invalid").when(F.col("source").isNull(), "inserted").when(F.col("source") == "A", "updated").otherwise("ambiguous")
    out = report.feed_summary(rows.withColumn("outcome", outcome))
    return out.withColumn("failure_messages", F.array_join("failure_messages", "|"))


@query("SELECT DISTINCT k FROM (SELECT item_id AS k FROM items WHERE source IS NULL UNION ALL SELECT item_id FROM saved UNION ALL SELECT item_id FROM media WHERE flag = 'R')", "items", "saved", "media")
def g6_union_keys(t: Tables) -> DataFrame:
    key = lambda df: df.select(F.col("item_id").alias("k"))
    return report.union_keys(key(t.items.filter("source IS NULL")), key(t.saved), key(t.media.filter("flag = 'R'")))


@query("""WITH d AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('{"details": "', p_name, '", "description": "https://x"}') WHEN 1 THEN p_type WHEN 2 THEN concat('{broken ', p_name, '}') WHEN 3 THEN '{"description": "http://only"}' WHEN 4 THEN concat('{"card_texts": ["', p_type, '", "Metals content"]}') END AS details FROM part),
j AS (SELECT *, CASE WHEN json_valid(coalesce(details, '')) AND left(trim(details), 1) = '{' THEN json(details) END AS o FROM d),
f AS (SELECT *, list_filter(list_transform(list_concat([json_extract_string(o, '$.details'), json_extract_string(o, '$.detail'), json_extract_string(o, '$.description')], coalesce(CAST(json_extract_string(o, '$.card_texts[*]') AS VARCHAR[]), [])), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '' AND NOT contains(lower(x), 'http://') AND NOT contains(lower(x), 'https://') AND lower(x) <> 'metals content') AS v FROM j)
SELECT p_partkey, CASE WHEN o IS NOT NULL AND len(v) > 0 THEN array_to_string(v, ' | ') END AS "after", CASE WHEN o IS NULL THEN CASE WHEN starts_with(coalesce(details, ''), '{') AND ends_with(details, '}') THEN 'invalid' ELSE 'noop' END WHEN len(v) = 0 THEN 'unresolved' WHEN details = array_to_string(v, ' | ') THEN 'noop' ELSE 'updated' END AS outcome FROM f""".replace("\\\\", "\\"))
def h21_repaired_details(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 6
    text = F.when(k == 0, F.concat(F.lit('{"details": "'), "p_name", F.lit('", "description": "https://x"}'))).when(k == 1, F.col("p_type")).when(k == 2, F.concat(F.lit("{broken "), "p_name", F.lit("}")))
    text = text.when(k == 3, '{"description": "http://only"}').when(k == 4, F.concat(F.lit('{"card_texts": ["'), "p_type", F.lit('", "Metals content"]}')))
    return enrich.repaired_details(t.part.select("p_partkey", text.alias("details"))).select("p_partkey", "after", "outcome")


@query("SELECT s_suppkey, concat('g', CAST(CASE WHEN s_nationkey % 5 = 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END AS VARCHAR)) AS group_id FROM supplier")
def c12_alias_groups(t: Tables) -> DataFrame:
    """Names of every fifth nation are aliases of the next one."""
    sheets = t.supplier.join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey").select("s_suppkey", F.concat(F.lit("new "), F.lower("n_name")).alias("sheet"))
    other = t.nation.select(((F.col("n_nationkey") + 24) % 25).alias("_k"), F.col("n_name").alias("target"))
    aliases = t.nation.filter("n_nationkey % 5 = 0").join(other, F.col("n_nationkey") == F.col("_k")).select(F.col("n_name").alias("alias"), "target")
    return match.group_of_name(sheets, t.groups, aliases=aliases).select("s_suppkey", "group_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 40 < 25 THEN concat('g', CAST(p_partkey % 40 AS VARCHAR)) WHEN p_size < 25 THEN concat('g', CAST(p_size AS VARCHAR)) ELSE concat('g', CAST(p_partkey % 40 AS VARCHAR)) END AS group_id FROM part")
def c13_configured_group(t: Tables) -> DataFrame:
    g = lambda c: F.concat(F.lit("g"), c.cast("string"))
    rows = t.part.select("p_partkey", g(F.col("p_partkey") % 40).alias("configured"), g(F.col("p_size")).alias("brand"))
    return match.configured_group(rows, t.groups).select("p_partkey", "group_id")


@query("""WITH e AS (SELECT CAST(max("at") AS DATE) AS e FROM quotes WHERE key IN ('pt', 'pd', 'rh')), s AS (SELECT e - CAST(i AS INTEGER) AS day FROM e, range(14) r(i)),
d AS (SELECT key, CAST("at" AS DATE) AS day, arg_max(price_oz, "at") AS p FROM quotes WHERE key IN ('pt', 'pd', 'rh') GROUP BY ALL),
w AS (SELECT s.day, max(CASE WHEN key = 'pt' THEN p END) AS pt, max(CASE WHEN key = 'rh' THEN p END) AS rh FROM s LEFT JOIN d ON d.day = s.day GROUP BY s.day),
c AS (SELECT day, last_value(pt IGNORE NULLS) OVER u AS pt, last_value(rh IGNORE NULLS) OVER u AS rh FROM w WINDOW u AS (ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT CAST(day AS VARCHAR) AS day, pt AS pt_usd, CASE WHEN lag(pt) OVER (ORDER BY day) <> 0 THEN round((pt - lag(pt) OVER (ORDER BY day)) / lag(pt) OVER (ORDER BY day) * 100, 2) ELSE 0 END AS pt_change, round(rh * 0.917, 2) AS rh_shown, 0.917 AS fx_rate FROM c""", "quotes")
def p7_market_days(t: Tables) -> DataFrame:
    out = price.market_days(t.quotes, "at", "price_oz", "key", 14, "eur", 0.917)
    return out.select(F.col("day").cast("string").alias("day"), "pt_usd", "pt_change", "rh_shown", "fx_rate")


@query("SELECT least(greatest(coalesce(max(CASE WHEN k = 3 THEN k * 27.5 END), 80), 0), 100) / 100 AS rate FROM roles", "roles")
def p4_rate_setting(t: Tables) -> DataFrame:
    settings = t.roles.select(F.col("k").cast("string").alias("key"), (F.col("k") * 27.5).cast("string").alias("value"))
    return price.rate_setting(settings, "3").select("rate")


@query("SELECT item_id, serial_code FROM items WHERE serial_code IS NOT NULL ORDER BY serial_code DESC, item_id LIMIT 40", "items")
def f2_sorted(t: Tables) -> DataFrame:
    return search.sorted_by(t.items.filter("serial_code IS NOT NULL"), "-serial_code").limit(40).select("item_id", "serial_code")  # a page


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('brand-', CAST(p_size AS VARCHAR)) WHEN p_partkey % 3 = 1 THEN nullif(trim(regexp_replace(regexp_replace(translate(lower(trim(p_name)), '_ ', '--'), '[^a-z0-9\-]+', '', 'g'), '-+', '-', 'g'), '-'), '') END AS h16 FROM part""".replace("\\\\", "\\"))
def h16_brand_slug(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    url = F.when(k == 0, F.concat(F.lit("https://x/en/CarBrand/Brand-"), F.col("p_size").cast("string"), F.lit("/page/2?x=1"))).otherwise("https://x/other")
    return t.part.select("p_partkey", C.brand_slug(url, F.lit("12"), F.when(k == 1, F.col("p_name"))).alias("h16"))


BRAND = "CAST(replace(p_brand, 'Brand#', '') AS INTEGER)"
SHEET_PT = f"CAST(CASE WHEN {BRAND} % 4 = 1 THEN p_size ELSE 1000 + p_size + 0.5 END AS DOUBLE)"


@query(f"SELECT concat('sheet ', {BRAND}) AS sheet, CASE WHEN {BRAND} % 4 = 2 THEN 10 ELSE 4 END AS pt, 6 AS pd, 8 AS rh FROM part GROUP BY ALL")
def h12_metal_columns(t: Tables) -> DataFrame:
    """Some sheets have totals, and a second exact header further on, which wins."""
    heads = report.exact_metal_columns(_cells(t).filter("row <= 3"))
    return heads.select("sheet", "pt", "pd", "rh")


@query(f"SELECT concat('sheet ', {BRAND}) AS sheet, concat('KT ', CAST(p_partkey AS VARCHAR)) AS serial_code, CASE {BRAND} % 4 WHEN 1 THEN p_size / 1000 WHEN 2 THEN p_size + 7 ELSE 1000 + p_size + 0.5 END AS pt_ppm FROM part")
def h12_j3_enrichment_rows(t: Tables) -> DataFrame:
    """Rows of enrichment sheets: metals come from their exact columns, and grams stay as they are."""
    groups = t.groups.withColumn("sheet_name", F.concat(F.lit("SHEET "), F.substring("id", 2, 9)))
    return jobs.rows_for_enrichment(_cells(t), groups).select("sheet", "serial_code", "pt_ppm")


@query(f"""WITH r AS (SELECT row_no, n_name, {ISSUE.replace("model", "coalesce(model, n_name)")} AS issue, concat_ws('|', concat('g', CAST(n_nationkey AS VARCHAR)), {ns('serial_code')}, {ASSAY}) AS sig FROM items JOIN nation ON concat('g', CAST(n_nationkey AS VARCHAR)) = group_id WHERE source IS NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY n_name, sig, issue IS NULL ORDER BY row_no) AS n FROM r)
SELECT n_name AS file, count(CASE WHEN issue IS NULL AND n = 1 AND sig NOT IN (SELECT {SIG} FROM items WHERE source IS NOT NULL) THEN 1 END) AS inserted, count(CASE WHEN issue IS NULL AND (n > 1 OR sig IN (SELECT {SIG} FROM items WHERE source IS NOT NULL)) THEN 1 END) AS skipped, count(issue) AS invalid FROM n GROUP BY n_name""", "items")
def j2_import_fixed(t: Tables) -> DataFrame:
    named = t.items.filter("source IS NULL").join(t.nation.select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("group_id"), "n_name"), "group_id")
    rows = named.drop("group_id").withColumnRenamed("row_no", "row").withColumns({"manufacturer": F.lower("n_name"), "file": F.col("n_name")})
    return jobs.import_fixed(rows, t.items.filter("source IS NOT NULL"), t.groups)["report"]


@query(f"SELECT concat('sheet ', {BRAND}) AS sheet, concat('KT ', CAST(p_partkey AS VARCHAR)) AS serial_code, p_size / 10 AS weight_kg, {SHEET_PT} AS pt_ppm FROM part WHERE p_size > 0 AND p_partkey % 3 <> 0")
def j1_import_cells(t: Tables) -> DataFrame:
    """New items of the free-layout sheets; the table holds the analyses of a third of the rows."""
    groups = t.groups.withColumn("sheet_name", F.concat(F.lit("SHEET "), F.substring("id", 2, 9)))
    return jobs.import_cells(_cells(t), _known_cells(t), groups)["items"].select("sheet", "serial_code", "weight_kg", "pt_ppm")


def _known_cells(t: Tables) -> DataFrame:
    b = F.regexp_replace("p_brand", "Brand#", "").cast("int")
    pt = F.when(b % 4 == 1, F.col("p_size").cast("double")).otherwise(1000 + F.col("p_size") + 0.5)
    return t.part.filter("p_partkey % 3 = 0").select(F.when(b < 25, F.concat(F.lit("g"), b.cast("string"))).alias("group_id"), F.concat(F.lit("kt-"), F.col("p_partkey").cast("string")).alias("serial_code"), (F.col("p_size") / 10).alias("weight_kg"), pt.alias("pt_ppm"), F.lit(None).cast("double").alias("pd_ppm"), F.lit(None).cast("double").alias("rh_ppm"))


ENRICHED = ["weight_kg", "pt_ppm", "pd_ppm", "rh_ppm", "shape_code"]


def _enriched_sql() -> str:
    """Rows of all files with their outcome, as common table expressions."""
    at = {"u": "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "b": "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"}
    first = [f"first_value({c} IGNORE NULLS) OVER {w} AS {w}_{c}" for w in at for c in ENRICHED] + [f"first_value(CASE WHEN weight_kg > 0 AND weight_kg <= 50 THEN weight_kg END IGNORE NULLS) OVER {w} AS {w}_sound" for w in at]
    state = lambda w, c: f"CASE WHEN {w}_{c} > 50 THEN coalesce({w}_sound, {w}_{c}) ELSE {w}_{c} END" if c == "weight_kg" else f"{w}_{c}"
    differs = " OR ".join(f"({state('u', c)}) IS DISTINCT FROM ({state('b', c)})" for c in ENRICHED)
    order = "PARTITION BY group_id, serial ORDER BY kind, file, row_no"
    return f"""r AS (SELECT *, model AS file, {ns('serial_code')} AS serial, {USABLE} AND trim(coalesce(model, '')) <> '' AND ({' OR '.join(f'{c} IS NOT NULL' for c in ENRICHED)}) AS valid, concat_ws('|', {SIG}, coalesce(upper(shape_code), '')) AS sig FROM items WHERE source IS NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY file, valid, sig ORDER BY row_no) AS again FROM r),
x AS (SELECT group_id, {ns('serial_code')} AS serial, 0 AS kind, NULL AS file, NULL AS row_no, {', '.join(ENRICHED)} FROM items WHERE source = 'A' UNION ALL SELECT group_id, serial, 1, file, row_no, {', '.join(ENRICHED)} FROM m WHERE valid AND again = 1),
n AS (SELECT group_id, serial, count(*) AS n FROM x WHERE kind = 0 GROUP BY ALL),
f AS (SELECT *, row_number() OVER ({order}) AS rn, {', '.join(first)} FROM x WINDOW {', '.join(f'{w} AS ({order} {rows})' for w, rows in at.items())}),
o AS (SELECT file, group_id, CASE WHEN n > 1 THEN 'ambiguous' WHEN rn = 1 THEN 'created' WHEN {differs} THEN 'updated' ELSE 'noop' END AS outcome FROM f LEFT JOIN n USING (group_id, serial) WHERE kind = 1
 UNION ALL SELECT file, group_id, CASE WHEN valid THEN 'duplicate_in_file' ELSE 'invalid' END FROM m WHERE NOT valid OR again > 1),
c AS (SELECT group_id, min(file) AS file FROM o WHERE outcome = 'created' AND group_id NOT IN (SELECT group_id FROM items WHERE source = 'A') GROUP BY group_id),
d AS (SELECT file, count(*) AS rows_scanned, {', '.join(f"count(CASE WHEN outcome = '{o}' THEN 1 END) AS {n}" for n, o in report.ENRICHMENT.items())}, (SELECT count(*) FROM c WHERE c.file = o.file) AS groups_created FROM o GROUP BY file)"""


def _enriched(t: Tables) -> dict[str, DataFrame]:
    return jobs.enrich_items(t.items.filter("source = 'A'"), t.items.filter("source IS NULL").withColumn("file", F.col("model")), ["row_no"])


@query(f"WITH {_enriched_sql()} SELECT * FROM d", "items")
def d1_j3_enrich(t: Tables) -> DataFrame:
    """The ten counters of each file of rows without a source, against the items of source A."""
    return _enriched(t)["report"]


@query(f"WITH {_enriched_sql()} SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ['rows_scanned', *report.ENRICHMENT, 'groups_created'])} FROM d", "items")
def d2_j3_totals(t: Tables) -> DataFrame:
    """Their sums over all files."""
    return _enriched(t)["totals"]


@query(f"SELECT count(*) AS n, round(count(*) * 0.039, 6) AS cost, round(count(*) * 0.041, 6) AS cost_verified, count(*) * 0.041 > 100 AS \"over\" FROM items WHERE {PRICEABLE}", "items")
def d21_cost(t: Tables) -> DataFrame:
    return report.cost(t.items.filter(Q.priceable()), 0.039, 0.002, 100)


@query("SELECT event_id, round(CASE WHEN p IS NULL OR p = 0 THEN 0 ELSE (price_oz - p) / p * 100 END, 4) AS change_pct FROM (SELECT event_id, price_oz, lag(price_oz) OVER (PARTITION BY key ORDER BY event_id) AS p FROM quotes)", "quotes")
def e3_change_series(t: Tables) -> DataFrame:
    return price.change_series(t.quotes, "key", "event_id", "price_oz").select("event_id", "change_pct")


@query("SELECT group_id, s AS serial, arg_min(item_id, struct_pack(n := -pt, u := item_id)) AS item_id FROM (SELECT group_id, " + ns("serial_code") + " AS s, item_id, coalesce(pt_ppm, 0) AS pt, model FROM items) GROUP BY group_id, s HAVING count(DISTINCT model) = 1", "items")
def e5_e11_family_product(t: Tables) -> DataFrame:
    p = t.items.select("group_id", C.normalize_serial("serial_code").alias("serial"), "item_id", F.coalesce("pt_ppm", F.lit(0.0)).alias("image_count"), F.col("item_id").alias("product_url"), F.col("model").alias("image_url"))
    return match.one_product_per_family(p, ["group_id", "serial"]).select("group_id", "serial", "item_id")


@query(f"SELECT group_id, arg_min(item_id, struct_pack(a := created_at, b := item_id)) AS item_id FROM items WHERE {PRICEABLE} GROUP BY group_id", "items")
def e6_earliest(t: Tables) -> DataFrame:
    return dedupe.first_per_key(t.items.filter(Q.priceable()), ["group_id"], ["created_at", "item_id"]).select("group_id", "item_id")


@query("""WITH h AS (SELECT DISTINCT concat(group_id, CAST(row_no % 4 AS VARCHAR)) AS w, concat('KT', CAST(row_no % 4 AS VARCHAR)) AS serial, concat('KT', CAST(row_no % 9 AS VARCHAR)) AS p FROM items)
SELECT w AS wanted_id, p AS primary_serial FROM (SELECT w, p, p = serial AS e, count(DISTINCT p) OVER (PARTITION BY w) > 1 AS many, max(CASE WHEN p = serial THEN 1 ELSE 0 END) OVER (PARTITION BY w) = 1 AS has_exact FROM h) WHERE NOT many OR (has_exact AND e)""", "items")
def e12_exact_preference(t: Tables) -> DataFrame:
    kt = lambda n: F.concat(F.lit("KT"), (F.col("row_no") % n).cast("string"))
    h = t.items.select(F.concat("group_id", (F.col("row_no") % 4).cast("string")).alias("wanted_id"), kt(4).alias("serial"), kt(9).alias("primary_serial")).distinct()
    return match.exact_preference(h).select("wanted_id", "primary_serial")


def _cells(t: Tables) -> DataFrame:
    """A long cell table from part: one sheet for each brand, three header rows, then data.

    By the brand's number modulo 4: 0 names in the second row, 1 grams, 2 totals and a second exact Pt column, 3 a Pt header beside the names.
    """
    p = t.part.select(F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("b"), "p_partkey", "p_name", "p_size")
    sheets = p.select("b").distinct()
    head = lambda row, col, text: F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), F.lit(text).alias("raw"))
    names = lambda row: [head(row, 1, "Model"), head(row, 2, "Serial Code"), head(row, 3, "Piece kg"), head(row, 11, "Extra Codes"), head(row, 13, "Details")]
    metals = lambda row: [head(row, 4, "Pt"), head(row, 6, "Pd"), head(row, 8, "Rh")]
    kind = lambda k: F.col("b") % 4 == k
    grams = [*names(1), *metals(2), head(1, 4, "=SUM(Kitko!A1)"), *(head(3, c, "ppm") for c in (4, 6, 8)), head(3, 10, "Price US$ Piece")]
    heads = F.when(kind(0), F.array(*names(2), *metals(1), head(3, 4, "ppm"))).when(kind(1), F.array(*grams)).when(kind(2), F.array(*names(1), *metals(2), head(2, 5, "Pt total"), head(2, 10, "Pt"), head(3, 4, "ppm"))).otherwise(F.array(*names(1), head(1, 4, "Pt"), *metals(2), head(3, 4, "ppm")))
    top = sheets.select("b", F.explode(heads).alias("c")).select("b", "c.*")
    cell = lambda col, value: F.struct(F.lit(col).alias("col"), value.alias("raw"))
    size = F.lpad(F.col("p_size").cast("string"), 3, "0")
    pt = F.when(kind(1), F.concat(F.lit("0,"), size)).otherwise(F.concat(F.lit("1 "), size, F.lit(",5")))
    cells = [cell(1, F.lit("M")), cell(2, F.concat(F.lit("KT "), F.col("p_partkey").cast("string"))), cell(3, (F.col("p_size") / 10).cast("string")), cell(4, pt), cell(10, F.when(kind(2), (F.col("p_size") + 7).cast("string"))), cell(11, F.col("p_name")), cell(30, F.lit("outside"))]
    data = p.select("b", (F.col("p_partkey") + 4).cast("int").alias("row"), F.explode(F.array(*cells)).alias("c")).select("b", "row", "c.*")
    both = top.unionByName(data)
    return both.select(F.lit("f").alias("file"), F.col("b").alias("sheet_idx"), F.concat(F.lit("sheet "), F.col("b").cast("string")).alias("sheet"), "row", "col", "raw")


@query(f"SELECT concat('sheet ', {BRAND}) AS sheet, concat('KT ', CAST(p_partkey AS VARCHAR)) AS serial_code, p_size / 10 AS weight_kg, {SHEET_PT} AS pt_ppm, len(list_distinct(list_transform(list_filter(list_transform(string_split(p_name, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: lower(x)))) AS n_codes FROM part")
def a3_b14_e8_e9_h27_j1_cells(t: Tables) -> DataFrame:
    groups = t.groups.withColumn("sheet_name", F.concat(F.lit("SHEET "), F.substring("id", 2, 9)))
    rows = jobs.rows_of_cells(io.window(_cells(t), 1, None, 25), groups)
    return rows.select("sheet", "serial_code", "weight_kg", "pt_ppm", F.size("codes").alias("n_codes"))


@query(f"SELECT concat('sheet ', {BRAND}) AS sheet, CASE WHEN {BRAND} % 4 = 0 THEN 2 ELSE 1 END AS row, CASE WHEN {BRAND} % 4 = 3 THEN 4 ELSE 3 END AS overlap, {BRAND} % 4 = 3 AS fits FROM part GROUP BY ALL")
def g3_g4_header_overlap(t: Tables) -> DataFrame:
    return report.has_headers(_cells(t), ["model", "serialcode", "piecekg", "pt"]).select("sheet", "row", "overlap", "fits")


FILL_KEYS = f"SELECT source, group_id, {ns('serial_code')} AS serial, row_no, weight_kg AS w, pt_ppm AS p, shape_code AS s FROM items WHERE {ns('serial_code')} LIKE 'KT%'"


@query(f"""WITH a AS ({FILL_KEYS}), x AS (SELECT *, 0 AS kind FROM a WHERE source = 'A' UNION ALL SELECT *, 1 FROM a WHERE source IS DISTINCT FROM 'A'), n AS (SELECT group_id, serial, count(*) AS items FROM x WHERE kind = 0 GROUP BY ALL),
f AS (SELECT *, row_number() OVER o AS rn, first_value(w IGNORE NULLS) OVER u AS fw, first_value(CASE WHEN w > 0 AND w <= 50 THEN w END IGNORE NULLS) OVER u AS gw, first_value(p IGNORE NULLS) OVER u AS fp, first_value(s IGNORE NULLS) OVER u AS fs,
 first_value(w IGNORE NULLS) OVER b AS bw, first_value(CASE WHEN w > 0 AND w <= 50 THEN w END IGNORE NULLS) OVER b AS bgw, first_value(p IGNORE NULLS) OVER b AS bp, first_value(s IGNORE NULLS) OVER b AS bs
 FROM x WINDOW o AS (PARTITION BY group_id, serial ORDER BY kind, row_no), u AS (PARTITION BY group_id, serial ORDER BY kind, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY group_id, serial ORDER BY kind, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT f.group_id, f.serial, row_no, CASE WHEN items > 1 THEN 'ambiguous' WHEN rn = 1 THEN 'created' WHEN CASE WHEN fw > 50 THEN coalesce(gw, fw) ELSE fw END IS DISTINCT FROM CASE WHEN bw > 50 THEN coalesce(bgw, bw) ELSE bw END OR fp IS DISTINCT FROM bp OR fs IS DISTINCT FROM bs THEN 'updated' ELSE 'noop' END AS outcome,
 CASE WHEN items > 1 THEN NULL WHEN fw > 50 THEN coalesce(gw, fw) ELSE fw END AS after_weight_kg, CASE WHEN items > 1 THEN NULL ELSE fp END AS after_pt_ppm, CASE WHEN items > 1 THEN NULL ELSE fs END AS after_shape_code FROM f LEFT JOIN n USING (group_id, serial) WHERE kind = 1""", "items")
def e10_j3_progressive_fill(t: Tables) -> DataFrame:
    some = t.items.withColumn("serial", C.normalize_serial("serial_code")).filter(F.col("serial").startswith("KT"))
    old = F.coalesce(F.col("source") == "A", F.lit(False))
    return enrich.progressive_fill(some.filter(old), some.filter(~old), ["group_id", "serial"], ["row_no"], ["weight_kg", "pt_ppm", "shape_code"])


@query("WITH e AS (SELECT CAST(max(\"at\") AS DATE) AS e FROM quotes), s AS (SELECT DISTINCT key, e - CAST(i AS INTEGER) AS day FROM quotes, e, range(14) r(i)), d AS (SELECT key, CAST(\"at\" AS DATE) AS day, arg_max(price_oz, \"at\") AS price_oz FROM quotes GROUP BY ALL) SELECT key, CAST(s.day AS VARCHAR) AS day, price_oz FROM s LEFT JOIN d USING (key, day)", "quotes")
def e14_p7_daily(t: Tables) -> DataFrame:
    return price.daily(t.quotes, "at", "price_oz", 14, "key").select("key", F.col("day").cast("string").alias("day"), "price_oz")


@query("SELECT item_id, model, total, 41 AS first_index, CAST(least(60, total) AS BIGINT) AS last_index, CAST(greatest(ceil(total / 20), 1) AS BIGINT) AS last_page FROM (SELECT item_id, model, serial_code, count(*) OVER () AS total FROM items WHERE group_id = 'g2') ORDER BY model, item_id LIMIT 20 OFFSET 40", "items")
def f1_f2_page(t: Tables) -> DataFrame:
    return search.page(t.items.filter("group_id = 'g2'").select("item_id", "model"), 3, 20, ["model", "item_id"])


@query("""WITH p AS (SELECT item_id, group_id, pt_ppm AS v, row_number() OVER (PARTITION BY group_id ORDER BY pt_ppm, item_id) AS pos FROM items WHERE pt_ppm IS NOT NULL),
j AS (SELECT a.item_id, b.item_id AS other, row_number() OVER (PARTITION BY a.item_id ORDER BY abs(b.v - a.v), abs(b.pos - a.pos), b.pos) AS rank FROM (SELECT p.*, pos + d AS q FROM p, (SELECT unnest(generate_series(-4, 4)) AS d) WHERE d <> 0) a JOIN p b ON b.group_id = a.group_id AND b.pos = a.q)
SELECT item_id, other, rank FROM j WHERE rank <= 4""", "items")
def f4_similar_items(t: Tables) -> DataFrame:
    """Four similar items of the group for every item."""
    return neighbours.similar_items(t.items, 4).select("item_id", "other", "rank")


@query(f"""WITH s AS (SELECT s_suppkey AS search_id, concat('T-', CAST(s_suppkey * 7 AS VARCHAR)) AS p, concat('T', CAST(s_suppkey * 7 AS VARCHAR)) AS n FROM supplier),
o AS (SELECT 'p' AS kind, lower(serial_code) AS text, item_id FROM items UNION SELECT 'p', lower(model), item_id FROM items UNION SELECT 'n', {ns('serial_code')}, item_id FROM items UNION SELECT 'p', lower(code), item_id FROM codes UNION SELECT 'n', {ns('code')}, item_id FROM codes),
x AS (SELECT DISTINCT kind, text FROM o), h AS (SELECT search_id, kind, text FROM s JOIN x ON (kind = 'p' AND contains(text, lower(p))) OR (kind = 'n' AND contains(text, n)))
SELECT search_id, count(DISTINCT item_id) AS items, min(item_id) AS first_item FROM h JOIN o USING (kind, text) GROUP BY search_id""", "items", "codes")
def b3_c17_f5_many_searches(t: Tables) -> DataFrame:
    """A search for each supplier over the index of texts."""
    asked = t.supplier.select(F.col("s_suppkey").alias("search_id"), F.concat(F.lit(" T-"), (F.col("s_suppkey") * 7).cast("string")).alias("text"))
    return textindex.searched(textindex.text_index(t.items, t.codes), asked).groupBy("search_id").agg(F.count("*").alias("items"), F.min("item_id").alias("first_item"))


DEEP = [("created_at", True), ("group_id", False), ("row_no", False)]


@query("SELECT row_no, group_id, position FROM (SELECT row_no, group_id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, group_id, row_no) - 1 AS position FROM items) WHERE position >= 99 * 50 AND position < 100 * 50", "items")
def f1_deep_page(t: Tables) -> DataFrame:
    """Page 100 of 50 rows, from the ranges that hold it."""
    return rank.page_at(rank.ranges(t.items.select("created_at", "group_id", "row_no"), DEEP), 100, 50).select("row_no", "group_id", "position")


@query("SELECT row_no, model FROM items ORDER BY model DESC NULLS LAST, pd_ppm NULLS FIRST, row_no LIMIT 30 OFFSET 60", "items")
def f1_next_pages(t: Tables) -> DataFrame:
    """The third page, reached by cursors."""
    order, cursor = [("model", True), ("pd_ppm", False), ("row_no", False)], None
    for _ in range(2):
        cursor = rank.cursor_of(rank.page_after(t.items, order, 30, cursor), order)
    return rank.page_after(t.items, order, 30, cursor).select("row_no", "model")


@query("SELECT item_id, group_id, CAST(rank AS BIGINT) AS rank FROM (SELECT item_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY pt_ppm DESC NULLS LAST, item_id) AS rank FROM items) WHERE rank <= 5", "items")
def f4_similar(t: Tables) -> DataFrame:
    return search.similar(t.items, 5).select("item_id", "group_id", "rank")


@query("""WITH c AS (SELECT trim(serial_code) AS c FROM items UNION ALL SELECT trim(code) FROM codes), u AS (SELECT lower(c) AS l, min(c) AS code FROM c WHERE contains(lower(c), 't-1') GROUP BY 1)
SELECT code FROM u ORDER BY starts_with(l, 't-1') DESC, array_to_string(list_transform(regexp_extract_all(l, '(\\d+|\\D+)'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(p, 20, '0') ELSE p END), ''), code LIMIT 10""".replace("\\\\", "\\"), "items", "codes")
def f5_f9_suggestions(t: Tables) -> DataFrame:
    return search.suggestions(t.items, t.codes, "T-1", 10)


@query("SELECT item_id, serial_code FROM items WHERE " + PRICEABLE + " AND serial_code IS NOT NULL ORDER BY serial_code, item_id LIMIT 5", "items")
def f6_sample(t: Tables) -> DataFrame:
    return t.items.filter(Q.priceable() & F.col("serial_code").isNotNull()).orderBy("serial_code", "item_id").limit(5).select("item_id", "serial_code")


@query("SELECT user_id, item_id, CAST(day AS VARCHAR) AS day FROM saved WHERE user_id = 7 AND item_id IN (SELECT item_id FROM items)", "saved", "items")
def f8_saved(t: Tables) -> DataFrame:
    return search.saved_items(t.saved, t.items, 7).select("user_id", "item_id", F.col("day").cast("string").alias("day"))


@query("SELECT path FROM (SELECT concat('a/', CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE CAST(p_partkey % 12 AS VARCHAR) END, '/', CASE WHEN p_partkey % 13 = 0 THEN '~$' ELSE '' END, p_name, CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN '.XLSX' ELSE '.csv' END) AS path FROM part) WHERE path LIKE '%.XLSX' AND path NOT LIKE '%/~$%'")
def a4_f10_file_order(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat(F.lit("a/"), F.when(k % 3 == 0, "x").otherwise((k % 12).cast("string")), F.lit("/"), F.when(k % 13 == 0, "~$").otherwise(""), "p_name", k.cast("string"), F.when(k % 2 == 0, ".XLSX").otherwise(".csv"))
    return search.file_order(t.part.select(path.alias("path")))


@query("SELECT group_id, serial FROM (SELECT DISTINCT group_id, " + ns("serial_code") + " AS serial FROM items WHERE source IS NULL EXCEPT SELECT group_id, " + ns("serial_code") + " FROM items WHERE source = 'A')", "items")
def g2_unmatched(t: Tables) -> DataFrame:
    keys = lambda cond: t.items.filter(cond).select("group_id", C.normalize_serial("serial_code").alias("serial"))
    return report.unmatched(keys("source IS NULL"), keys("source = 'A'"), ["group_id", "serial"])


@query(f"WITH {SPOT} SELECT item_id, {value_sql('0.8')} AS current, {value_sql('0.9')} AS preview, round({value_sql('0.9')} - {value_sql('0.8')}, 2) AS difference FROM items, spot", "items", "quotes")
def c22_p1_p4_p5_what_if(t: Tables) -> DataFrame:
    return price.what_if(t.items, latest_spot(t), 0.8, 0.9).select("item_id", "current", "preview", "difference")


@query("SELECT item_id, 0.0::DOUBLE AS price FROM items", "items")
def p2_no_feed(t: Tables) -> DataFrame:
    none = latest_spot(t).limit(0)
    return price.priced(t.items, none).select("item_id", "price")


def _estimate_sql() -> str:
    g = "(CASE WHEN row_no % 2 = 0 THEN w * 1000 ELSE w END)"
    v = lambda m, usd, rate: f"greatest(coalesce({m}_ppm, 0), 0) / 1000000 * {g} * {usd} * {rate} * (1 - 0.053)"
    total = " + ".join([v("pt", "30.57", "0.973"), v("pd", "28.23", "0.973"), v("rh", "149.93", "0.91")])
    return f"SELECT row_no, round({g}, 2) AS weight_in_grams, round({v('pt', '30.57', '0.973')}, 2) AS pt_value_usd, round({total}, 2) AS total_usd, round(({total}) * 0.917, 2) AS total_eur FROM (SELECT *, greatest(coalesce(weight_kg, 0), 0) AS w FROM items)"


@query(_estimate_sql(), "items")
def p3_estimate(t: Tables) -> DataFrame:
    rows = t.items.select("row_no", F.coalesce("weight_kg", F.lit(0.0)).alias("weight"), F.when(F.col("row_no") % 2 == 0, " KG").otherwise("g").alias("weight_unit"), *(F.coalesce(f"{m}_ppm", F.lit(0.0)).alias(f"{m}_ppm") for m in price.METALS), F.lit(30.57).alias("pt_usd_per_gram"), F.lit(28.23).alias("pd_usd_per_gram"), F.lit(149.93).alias("rh_usd_per_gram"), F.lit(97.3).alias("pt_rate"), F.lit(0.00973).alias("pd_rate"), F.lit(0.91).alias("rh_rate"), F.lit(5.3).alias("humidity_rate"))
    return price.estimate(rows, 0.917).select("row_no", "weight_in_grams", "pt_value_usd", "total_usd", "total_eur")


@query("SELECT o_orderkey, round(o_totalprice * CASE o_orderpriority WHEN '1-URGENT' THEN 0.513 WHEN '2-HIGH' THEN 2.037 ELSE 1.0 END, 2) AS converted FROM orders")
def p8_convert(t: Tables) -> DataFrame:
    names = t.orders.select(F.col("o_orderpriority").alias("currency")).distinct()
    rates = names.filter(F.col("currency").isin("1-URGENT", "2-HIGH")).withColumn("rate", F.when(F.col("currency") == "1-URGENT", 0.513).otherwise(2.037))
    return price.converted(t.orders, rates, "o_totalprice", "o_orderpriority").select("o_orderkey", "converted")


def _repair_sql(chosen: str, assignment: str) -> str:
    return f"""WITH old AS (SELECT row_no, {FP} AS fp FROM items WHERE NOT coalesce({chosen}, false)),
n AS (SELECT row_no, {FP} AS fp FROM (SELECT * REPLACE ({assignment}) FROM items WHERE {chosen}))
SELECT row_no, CASE WHEN fp IN (SELECT fp FROM old WHERE fp IS NOT NULL) THEN NULL WHEN row_number() OVER (PARTITION BY fp ORDER BY row_no) = 1 THEN fp END AS assay_fingerprint FROM n"""


@query(_repair_sql("(source IS NULL AND pt_ppm > 0 AND pt_ppm < 100)", "pt_ppm * 1000 AS pt_ppm, pd_ppm * 1000 AS pd_ppm, rh_ppm * 1000 AS rh_ppm"), "items")
def p9_repaired_units(t: Tables) -> DataFrame:
    chosen = F.col("source").isNull() & (F.col("pt_ppm") > 0) & (F.col("pt_ppm") < 100)
    return enrich.repaired_units(t.items, chosen).select("row_no", "assay_fingerprint")


@query(_repair_sql("(weight_kg > 50)", "weight_kg / 1000 AS weight_kg"), "items")
def p10_repaired_weights(t: Tables) -> DataFrame:
    return enrich.repaired_weights(t.items).select("row_no", "assay_fingerprint")


@query("SELECT coalesce(i.id, c.id) AS id, coalesce(c.value, i.value) AS value FROM (SELECT row_no AS id, model AS value FROM items WHERE source IS NOT NULL) i FULL JOIN (SELECT row_no AS id, shape_code AS value FROM items WHERE source IS DISTINCT FROM 'A') c ON c.id = i.id", "items")
def a9_a10_upsert(t: Tables) -> DataFrame:
    """A table in versions: items with a source, then changes to those of source R and all without a source."""
    path = shared_folder(t.spark)
    row = lambda df, value: df.select(F.col("row_no").alias("id"), F.col(value).alias("value"))
    changes = row(t.items.filter("NOT source <=> 'A'"), "shape_code")
    versions.upsert(t.spark, path, row(t.items.filter("source IS NOT NULL"), "model"), "id", "first", buckets=8)
    versions.upsert(t.spark, path, changes, "id", "second")
    versions.upsert(t.spark, path, changes, "id", "second")  # tried again: changes nothing
    return versions.read(t.spark, path)


@query("SELECT k AS key, arg_max(v, event_id) AS url FROM (SELECT event_id, 'k' AS k, json_extract_string(props, '$.k') AS v FROM quotes) WHERE v IS NOT NULL AND trim(v) <> '' GROUP BY k", "quotes")
def a2_mapping(t: Tables) -> DataFrame:
    return io.mapping(t.quotes, "props", ["event_id"])


@query("SELECT DISTINCT user_id AS media_id FROM quotes WHERE key = 'view' OR key = 'pt'", "quotes")
def a5_report_media(t: Tables) -> DataFrame:
    raw = t.quotes.select(F.when(F.col("key").isin("view", "pt"), F.concat(F.lit(" "), F.col("user_id").cast("string"))).otherwise("x").alias("media_id"))
    return io.report_media(raw)


@query("SELECT DISTINCT item_id FROM media WHERE media_id IN (SELECT row_no * 3 FROM items WHERE model = 'Model 2')", "items", "media")
def a6_report_items(t: Tables) -> DataFrame:
    """A report without model ids: its items come from its media."""
    raw = t.items.filter("model = 'Model 2'").select((F.col("row_no") * 3).cast("string").alias("media_id"), F.lit("  ").alias("model_id"))
    return io.report_items(raw, t.media)


@query("SELECT DISTINCT item_id FROM items WHERE model = 'Model 2' AND source IS NOT NULL", "items")
def a6_report_model_ids(t: Tables) -> DataFrame:
    """A report some of whose rows have a model id: only these count, and its media are not looked up."""
    raw = t.items.filter("model = 'Model 2'").select((F.col("row_no") * 3).cast("string").alias("media_id"), F.when(F.col("source").isNotNull(), F.concat(F.lit(" "), "item_id")).otherwise(" ").alias("model_id"))
    return io.report_items(raw, t.media)


AUDIT_SQL = f"""WITH f AS (SELECT group_id, {ns('serial_code')} AS s FROM items WHERE {USABLE} GROUP BY ALL),
k AS (SELECT concat('KT', CAST(p_partkey AS VARCHAR)) AS key, concat('p', CAST(p_partkey AS VARCHAR)) AS url FROM part UNION SELECT concat('KT', CAST(p_partkey + 1 AS VARCHAR)), concat('p', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size > 40),
c AS (SELECT s FROM f WHERE s IN (SELECT key FROM k) GROUP BY s HAVING count(*) = 1),
l AS (SELECT DISTINCT {ns('code')} AS key, concat(group_id, '|', {ns('serial_code')}) AS family FROM codes JOIN items USING (item_id) WHERE {USABLE} AND {ns('code')} <> ''),
a AS (SELECT 'unmatched' AS file, concat(group_id, '|', s) AS key, '' AS targets FROM f WHERE s NOT IN (SELECT s FROM c) UNION ALL
 SELECT 'ambiguous_feed', key, array_to_string(list_sort(list(url)), '|') FROM k GROUP BY key HAVING count(*) > 1 UNION ALL
 SELECT 'ambiguous_codes', key, family FROM l WHERE key IN (SELECT key FROM l GROUP BY key HAVING count(*) > 1))"""


def _audit(t: Tables) -> dict[str, DataFrame]:
    """The audit against a feed of one product for each part; larger ones name the next part's serial too."""
    key = lambda n: F.concat(F.lit("KT"), n.cast("string"))
    both = F.array_compact(F.array(key(F.col("p_partkey")), F.when(F.col("p_size") > 40, key(F.col("p_partkey") + 1))))
    return jobs.audit(t.items, t.part.select(both.alias("families"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("product_url")), t.codes)


def _audit_files(t: Tables) -> DataFrame:
    """(file, key, targets) of the three audit files, read back as they were written."""
    done, folder = _audit(t), shared_folder(t.spark)
    io.write_audit(folder, unmatched=done["unmatched"].select("family"), ambiguous_feed=done["ambiguous_feed"].select("key", "targets"), ambiguous_codes=done["ambiguous_codes"])
    back = {name: io.read_report(t.spark, f"{folder}/{name}") for name in ("unmatched", "ambiguous_feed", "ambiguous_codes")}
    lone = back["unmatched"].select(F.lit("unmatched").alias("file"), F.col("family").alias("key"), F.lit("").alias("targets"))
    feed = back["ambiguous_feed"].select(F.lit("ambiguous_feed").alias("file"), "key", "targets")
    return lone.unionByName(feed).unionByName(back["ambiguous_codes"].select(F.lit("ambiguous_codes").alias("file"), "key", F.col("family").alias("targets")))


@query(AUDIT_SQL + " SELECT * FROM a", "items", "codes")
def a7_j8_audit_files(t: Tables) -> DataFrame:
    """The audit written as three CSV files and read again."""
    return _audit_files(t)


@query(AUDIT_SQL + " SELECT file, count(*) AS n, count(DISTINCT key) AS keys FROM a GROUP BY file", "items", "codes")
def a8_j8_audit_summary(t: Tables) -> DataFrame:
    """The counters of the audit's files, written as JSON and read again."""
    path = shared_folder(t.spark)
    io.write_summary(_audit_files(t).groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys")), path)
    return t.spark.read.schema("file string, n long, keys long").json(path)


@query(f"""WITH f AS (SELECT group_id, {ns('serial_code')} AS s FROM items WHERE {USABLE} GROUP BY ALL), k AS (SELECT DISTINCT concat('KT', CAST(p_partkey AS VARCHAR)) AS key FROM part WHERE p_size > 10), c AS (SELECT min(group_id) AS group_id, s FROM f WHERE s IN (SELECT key FROM k) GROUP BY s HAVING count(*) = 1)
SELECT f.group_id, f.s AS serial FROM f ANTI JOIN c ON c.group_id = f.group_id AND c.s = f.s""", "items")
def h18_j8_audit(t: Tables) -> DataFrame:
    products = t.part.filter("p_size > 10").select(C.serial_families(F.concat(F.lit("kt-"), F.col("p_partkey").cast("string")), F.concat(F.lit("KT "), F.col("p_partkey").cast("string"))).alias("families"), F.col("p_name").alias("product_url"))
    return jobs.audit(t.items, products)["unmatched"].select("group_id", "serial")


@query(f"""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_size % 9 = 0 THEN '' ELSE concat('https://x/i', CAST(p_partkey % 5 AS VARCHAR)) END AS image, concat('https://x/', CAST(p_partkey AS VARCHAR)) AS url, p_size, concat('g', CAST(p_partkey % 25 AS VARCHAR)) AS group_id, p_size % 10 <> 7 AS valid FROM part),
good AS (SELECT image, url, p_size, group_id, unnest([concat('KT', CAST(k AS VARCHAR)), concat('ALT', CAST(k % 60 AS VARCHAR))]) AS s FROM p WHERE valid AND image <> ''),
named AS (SELECT group_id, s, min(image) <> max(image) AS differ, arg_min(struct_pack(i := image, u := url), struct_pack(n := -p_size, u := url)) AS best FROM good GROUP BY ALL),
f AS (SELECT * FROM named WHERE NOT differ),
k AS (SELECT item_id, group_id, {ns('serial_code')} AS s FROM items UNION SELECT c.item_id, i.group_id, {ns('c.code')} FROM codes c JOIN items i ON i.item_id = c.item_id),
h AS (SELECT f.group_id, f.s, i.item_id, struct_pack(c := i.created_at, i := i.item_id) AS t, nullif({ns('i.serial_code')}, '') AS p, {PRICEABLE} AS able, i.item_id IN (SELECT item_id FROM media WHERE flag = 'R') AS img FROM f JOIN k ON k.group_id = f.group_id AND k.s = f.s JOIN items i ON i.item_id = k.item_id),
m AS (SELECT group_id, s, min(p) < max(p) AS many FROM h GROUP BY ALL),
u AS (SELECT h.* FROM h JOIN m ON h.group_id = m.group_id AND h.s = m.s WHERE NOT coalesce(many, false) OR p = h.s),
a AS (SELECT group_id, s, count(*) AS n, count(CASE WHEN able THEN 1 END) AS n_able, min(CASE WHEN able THEN t END) AS target, min(CASE WHEN img THEN t END) AS copy FROM u GROUP BY ALL),
e AS (SELECT target.i AS item_id, min(best.i) <> max(best.i) AS differ FROM a JOIN f ON f.group_id = a.group_id AND f.s = a.s WHERE n_able > 0 AND copy IS NULL GROUP BY ALL)
SELECT (SELECT count(*) FROM p) AS records_total, (SELECT count(*) FROM p WHERE valid) AS records_valid, (SELECT count(*) FROM p WHERE NOT valid) AS records_invalid, (SELECT count(*) FROM p WHERE valid AND image <> '') AS records_with_main_image, (SELECT count(*) FROM p WHERE valid AND image = '') AS records_without_main_image, CAST(0 AS BIGINT) AS records_rejected_placeholder_image,
(SELECT count(*) FROM f) AS families_available, (SELECT count(*) FROM named WHERE differ) + (SELECT count(*) FROM m) - (SELECT count(*) FROM a) + (SELECT count(*) FROM e WHERE differ) AS families_ambiguous, CAST(0 AS BIGINT) AS families_without_group, (SELECT count(*) FROM f) - (SELECT count(*) FROM m) AS families_without_items,
(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM a) AS matched_items, (SELECT CAST(coalesce(sum(n_able), 0) AS BIGINT) FROM a) AS priceable_items, CAST(0 AS BIGINT) AS skipped_not_in_media_report, CAST(0 AS BIGINT) AS skipped_checkpointed, CAST(0 AS BIGINT) AS skipped_not_failed_checkpoint, (SELECT CAST(coalesce(sum(n - n_able), 0) AS BIGINT) FROM a) AS skipped_not_priceable,
(SELECT count(*) FROM a WHERE n_able > 0 AND copy IS NOT NULL) AS skipped_existing_image, (SELECT count(DISTINCT copy.i) FROM a WHERE n_able > 0) AS copy_sources_available, (SELECT count(*) FROM e WHERE NOT differ) AS candidates_available, (SELECT count(*) FROM e WHERE NOT differ) AS candidates_selected""", "items", "codes", "media")
def d17_j9_image_candidates(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    products = t.part.select(
        text("https://x/", key).alias("product_url"), F.when(F.col("p_size") % 9 == 0, "").otherwise(text("https://x/i", key % 5)).alias("image_url"), F.col("p_size").alias("image_count"),
        text("g", key % 25).alias("group_id"), F.array(text("KT", key), text("ALT", key % 60)).alias("families"), F.when(F.col("p_size") % 10 == 7, "missing_serial").alias("issue"),
    )
    return jobs.image_candidates(t.items, t.codes, products, imaged=t.media.filter("flag = 'R'"))["funnel"]


def _feed(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    key = k.cast("string")
    null = F.lit(None).cast("string")
    return t.part.select(F.concat(F.lit("https://x/product/"), key).alias("product_url"), F.when(k % 9 != 0, F.concat(F.lit("https://x/carbrand/brand-"), (k % 6).cast("string"))).alias("brand_page_url"), null.alias("brand_slug"), null.alias("brand"), F.when(k % 11 != 0, F.concat(F.lit("kt "), key)).alias("serial_code"), F.col("p_name").alias("product_name"), null.alias("details"), null.alias("detail"), null.alias("description"), F.array(F.col("p_type")).alias("card_texts"))


FEED_SQL = """p AS (SELECT p_partkey AS k, concat('https://x/product/', CAST(p_partkey AS VARCHAR)) AS url, concat('brand-', CAST(p_partkey % 6 AS VARCHAR)) AS slug, sha1(concat('brand-', CAST(p_partkey % 6 AS VARCHAR), '|KT ', CAST(p_partkey AS VARCHAR), '|https://x/product/', CAST(p_partkey AS VARCHAR))) AS hash, p_partkey % 9 <> 0 AND p_partkey % 11 <> 0 AS valid FROM part),
i AS (SELECT k AS id, url, NULL AS hash FROM p WHERE k % 4 = 0 UNION ALL SELECT k + 1000000000, url, NULL FROM p WHERE k % 20 = 0 UNION ALL SELECT k + 2000000000, NULL, hash FROM p WHERE k % 5 = 1)"""


@query(f"""WITH {FEED_SQL}, m AS (SELECT p.k, 0 AS tier, id FROM p JOIN i ON i.url = p.url UNION ALL SELECT p.k, 1, id FROM p JOIN i ON i.hash = p.hash),
b AS (SELECT k, id FROM m QUALIFY tier = min(tier) OVER (PARTITION BY k)), n AS (SELECT valid, count(DISTINCT id) AS n FROM p LEFT JOIN b ON b.k = p.k GROUP BY p.k, valid)
SELECT count(CASE WHEN valid AND n = 0 THEN 1 END) AS inserted, count(CASE WHEN valid AND n = 1 THEN 1 END) AS updated, count(CASE WHEN valid AND n > 1 THEN 1 END) AS ambiguous, count(CASE WHEN NOT valid THEN 1 END) AS invalid FROM n""")
def a1_j5_import_feed(t: Tables) -> DataFrame:
    """The feed is written as JSON arrays, scanned in many tasks, and matched by address, else by hash; some addresses stand twice."""
    path = shared_folder(t.spark)
    arrays.write_arrays(_feed(t), path)
    return jobs.import_feed(saved(io.feed(t.spark, path)), _feed_items(t), t.groups.select(C.slug("name").alias("slug")))["report"]


@query(f"WITH {FEED_SQL} SELECT DISTINCT slug, concat('Brand ', slug[7:]) AS name FROM p WHERE valid AND slug NOT IN (SELECT concat('brand-', CAST(n_nationkey * 2 AS VARCHAR)) FROM nation)")
def h14_j5_new_groups(t: Tables) -> DataFrame:
    """Groups that a feed adds, named by their slugs."""
    known = t.nation.select(F.concat(F.lit("brand-"), (F.col("n_nationkey") * 2).cast("string")).alias("slug"))
    return jobs.import_feed(_feed(t), _feed_items(t), known)["groups"].select("slug", "name")


def _feed_items(t: Tables) -> DataFrame:
    k, url = F.col("p_partkey"), F.concat(F.lit("https://x/product/"), F.col("p_partkey").cast("string"))
    none = F.lit(None).cast("string")
    item = lambda cond, id_, url_, hash_: t.part.filter(cond).select(id_.alias("id"), url_.alias("source_url"), hash_.alias("source_hash"), F.when(k % 8 == 0, F.col("p_type")).alias("details"))
    hashed = C.feed_hash(F.concat(F.lit("brand-"), (k % 6).cast("string")), F.concat(F.lit("kt "), k.cast("string")), url)
    return item(k % 4 == 0, k, url, none).unionByName(item(k % 20 == 0, k + 1_000_000_000, url, none)).unionByName(item(k % 5 == 1, k + 2_000_000_000, none, hashed))


@query("SELECT concat('https://x/product/', CAST(p_partkey AS VARCHAR)) AS product_url, CASE WHEN p_partkey % 4 <> 0 THEN 'not_found' WHEN p_partkey % 8 = 0 THEN 'noop' ELSE 'updated' END AS outcome FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0")
def j6_repair_from_feed(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    items = t.part.filter(k % 4 == 0).select(k.alias("id"), F.concat(F.lit("https://x/product/"), k.cast("string")).alias("source_url"), F.lit(None).cast("string").alias("source_hash"), F.when(k % 8 == 0, F.col("p_type")).alias("details"))
    return jobs.repair_from_feed(_feed(t), items).select("product_url", "outcome")


@query(f"""WITH {CANDIDATES}, u AS (SELECT item_no, serial_code AS s FROM h JOIN r ON r.row_no = h.row_no WHERE n = 1),
x AS (SELECT row_no AS item_no, old, serial_code AS s, {FP} AS nf FROM (SELECT i.* REPLACE (u.s AS serial_code), i.serial_code AS old FROM u JOIN items i ON i.row_no = u.item_no)),
g AS (SELECT fp, min(row_no) AS low, max(row_no) AS high FROM (SELECT row_no, {FP} AS fp FROM items WHERE source = 'A') WHERE fp IS NOT NULL GROUP BY fp),
o AS (SELECT CASE WHEN coalesce(low <> item_no OR high <> item_no, false) THEN 'existing_assay' WHEN s IS NOT DISTINCT FROM old THEN 'noop' ELSE 'updated' END AS outcome FROM x LEFT JOIN g ON g.fp = x.nf UNION ALL SELECT CASE WHEN n = 0 THEN 'not_found' ELSE 'ambiguous' END FROM h WHERE n <> 1)
SELECT {', '.join(f"count(CASE WHEN outcome = '{o}' THEN 1 END) AS {o}" for o in jobs.OUTCOMES['repair_items'])} FROM o""", "items")
def j4_repair_items(t: Tables) -> DataFrame:
    """Counters of repairs of the items of source A by rows without a source."""
    return jobs.repair_items(t.items.filter("source = 'A'"), t.items.filter("source IS NULL"), ["weight_kg", "pt_ppm", "shape_code"])["report"]


@query("""WITH u AS (SELECT user_id, lang FROM users u WHERE is_active AND NOT EXISTS (SELECT 1 FROM roles r WHERE r.user_id = u.user_id AND role = 'admin') AND EXISTS (SELECT 1 FROM roles r WHERE r.user_id = u.user_id AND role = 'app_user'))
SELECT user_id, CASE WHEN lang = 'ar' THEN 'Ta' ELSE 'Te' END AS title, CASE WHEN lang = 'ar' THEN 'Ba' ELSE 'Be' END AS body, CASE WHEN lang = 'ar' THEN 'ar' ELSE 'en' END AS lang FROM u""", "users", "roles")
def j13_fan_out(t: Tables) -> DataFrame:
    one = t.region.agg(F.count("*").alias("n")).select(F.lit("Te").alias("title_en"), F.lit("Be").alias("body_en"), F.lit(" Ta").alias("title_ar"), F.lit("Ba").alias("body_ar"), F.lit("Th").alias("title_hu"), F.lit(" <p>&nbsp;</p> ").alias("body_hu"))
    return jobs.fan_out(t.users, t.roles, one)


LAST = """SELECT event_id, CASE WHEN v IS NOT NULL THEN 'fresh' WHEN g IS NOT NULL AND epoch("at") - epoch(ga) <= 3600 THEN 'stale' ELSE 'unavailable' END AS state, CASE WHEN v IS NOT NULL THEN v WHEN g IS NOT NULL AND epoch("at") - epoch(ga) <= 3600 THEN g END AS shown
FROM (SELECT *, last_value(v IGNORE NULLS) OVER w AS g, last_value(CASE WHEN v IS NOT NULL THEN "at" END IGNORE NULLS) OVER w AS ga FROM (SELECT event_id, key, date_trunc('second', "at") AS "at", CASE WHEN event_id % 3 = 0 THEN price_oz END AS v FROM quotes) WINDOW w AS (PARTITION BY key ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(LAST, "quotes")
def s2_last_known(t: Tables) -> DataFrame:
    q = t.quotes.select("event_id", "key", F.struct(F.date_trunc("second", "at").alias("a"), "event_id").alias("o"), F.date_trunc("second", "at").alias("at"), F.when(F.col("event_id") % 3 == 0, F.col("price_oz")).alias("v"))
    return price.last_known(q, "at", "v", "key", 3600, tie="event_id").select("event_id", "state", "shown")


@query("""WITH q AS (SELECT key, snap, "at", max(price_oz) AS p FROM (SELECT key, price_oz, CAST(0 AS BIGINT) AS snap, date_trunc('day', "at") AS "at" FROM quotes) WHERE price_oz > 0 AND key IN ('pt', 'pd', 'rh') GROUP BY ALL),
s AS (SELECT "at", max(CASE WHEN key = 'pt' THEN p END) AS pt_oz, max(CASE WHEN key = 'pd' THEN p END) AS pd_oz, max(CASE WHEN key = 'rh' THEN p END) AS rh_oz FROM q GROUP BY "at")
SELECT 'USD' AS currency, pt_oz, pd_oz, rh_oz FROM s WHERE pt_oz IS NOT NULL AND pd_oz IS NOT NULL AND rh_oz IS NOT NULL ORDER BY "at" DESC LIMIT 1""", "quotes")
def s1_latest_complete(t: Tables) -> DataFrame:
    from ..streaming import quotes as stream

    q = t.quotes.select("key", F.lit("USD").alias("currency"), F.date_trunc("day", "at").alias("fetched_at"), "price_oz")
    return stream.complete(q).select("currency", "pt_oz", "pd_oz", "rh_oz")


@query("SELECT row_no, round(coalesce(pt_ppm, 0) / 1000, 6) AS score FROM items", "items")
def f7_score_order(t: Tables) -> DataFrame:
    return t.items.select("row_no", F.round(F.coalesce("pt_ppm", F.lit(0.0)) / 1000, 6).alias("score")).orderBy(F.desc("score"), "row_no")