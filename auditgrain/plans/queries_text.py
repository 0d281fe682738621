"""Queries of the text functions and page sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ordering as od
from ..operators import spans as sp
from ..sources import pages as pg
from .registry import query

_LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"


def lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[​‌‍⁠﻿­]', '', 'g'), '[\\s ]+', ' ', 'g')) AS line FROM documents")
def p1_canonical_line(t):
    return t.documents.select("doc_id", tx.canonical_line(F.col("text")).alias("line"))


@query(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN text = '' THEN 'empty' END, CASE WHEN contains(text, chr(13)) THEN 'carriage_return' END, CASE WHEN regexp_matches(text, '[\t\x0b\f\x{a0}]') THEN 'other_whitespace' END,
 CASE WHEN contains(text, '  ') THEN 'double_space' END, CASE WHEN contains(text, ' ' || chr(10)) OR contains(text, chr(10) || ' ') THEN 'space_at_line_edge' END, CASE WHEN contains(text, chr(10) || chr(10) || chr(10)) THEN 'blank_line_run' END,
 CASE WHEN text <> '' AND regexp_matches(text, '^\s|\s$') THEN 'outer_whitespace' END], lambda x: x IS NOT NULL), ',') AS broken FROM documents""")
def p2_canonical_violations(t):
    return t.documents.select("doc_id", F.concat_ws(",", tx.canonical_violations(F.col("text"))).alias("broken"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents")
def p3_word_count(t):
    return t.documents.select("doc_id", tx.word_count(F.col("text")).alias("n"))


@query("SELECT page_id, lower(regexp_replace(trim(url || CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '// ' ELSE '' END), '/+$', '')) AS url FROM pages")
def p4_norm_url(t):
    tail = F.when(F.col("page_id") % 3 == 0, "/").when(F.col("page_id") % 3 == 1, "// ").otherwise("")
    return t.pages.select("page_id", tx.norm_url(F.concat("url", tail)).alias("url"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages")
def p5_host_of(t):
    return t.pages.select("page_id", tx.host_of(F.col("url")).alias("host"))


@query(r"""WITH h AS (SELECT page_id, string_split(regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', ''), '.') AS l FROM pages)
SELECT page_id, upper(left(x, 1)) || lower(substr(x, 2)) AS org FROM (SELECT page_id, CASE WHEN len(l) >= 3 AND length(l[-2]) <= 3 AND length(l[-1]) = 2 THEN l[-3] ELSE l[-2] END AS x FROM h)""")
def p6_org_from_host(t):
    return t.pages.select("page_id", tx.org_from_host(F.col("url")).alias("org"))


@query("""SELECT doc_id, regexp_replace(left(CASE WHEN s = '' THEN 'document' ELSE s END, 64), '[-.]+$', '') AS slug
FROM (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(source || '-' || text), '[^\\x00-\\x7f]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS s FROM documents)""")
def p7_slug(t):
    return t.documents.select("doc_id", tx.slug(F.col("source"), F.col("text")).alias("slug"))


@query()
def p7_slug_all(t):
    return t.documents.select("doc_id", tx.slug(F.col("source"), F.col("text")).alias("slug"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(replace(replace(replace(text, 'ß', 'ss'), 'æ', 'ae'), 'ø', 'o'))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def p8_company_slug(t):
    return t.documents.select("doc_id", tx.company_slug(F.col("text")).alias("slug"))


@query()
def p8_company_slug_all(t):
    return t.documents.select("doc_id", tx.company_slug(F.col("text")).alias("slug"))


@query("SELECT doc_id, CAST(TRY_CAST(replace(regexp_extract(text, '(\\d[\\d,]*)', 1), ',', '') AS BIGINT) AS DOUBLE) AS n FROM documents")
def p9_lenient_int(t):
    """The first number of each text; null where there is none, or where it does not fit."""
    return t.documents.select("doc_id", tx.lenient_int(F.col("text")).cast("double").alias("n"))


@query()
def p9_lenient_int_all(t):
    return t.documents.select("doc_id", tx.lenient_int(F.col("text")).alias("n"))


@query("SELECT page_id, regexp_matches(trim(CASE WHEN page_id % 4 = 0 THEN 'ftp://' || url ELSE url END), '^https?://[^\\s/]+') AS web FROM pages")
def p20_is_web_url(t):
    return t.pages.select("page_id", tx.is_web_url(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("ftp://"), "url")).otherwise(F.col("url"))).alias("web"))


@query(r"SELECT doc_id, left(text, 60000) AS text FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 60")
def p19_drop_thin(t):
    return pg.drop_thin(t.documents.select("doc_id", "text"), 60, 60_000)


@query("SELECT doc_id, length(text) AS n_chars, NULL AS n_bytes FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL, (length(text) * 3) // 4 FROM documents WHERE doc_id % 2 <> 0")
def p17_redact_source(t):
    kind = F.when(F.col("doc_id") % 2 == 0, "text").otherwise("pdf")
    return pg.redact_source(t.documents.select("doc_id", kind.alias("kind"), F.col("text").alias("content")), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.col("n_bytes").cast("double").alias("n_bytes"))


@query(r"SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS s FROM documents")
def f1_squash(t):
    return t.documents.select("doc_id", tx.squash(F.col("text")).alias("s"))


@query("SELECT doc_id, replace(replace(text, '–', '-'), '’', '''') AS s FROM documents")
def f2_normalise(t):
    return t.documents.select("doc_id", tx.normalise(F.col("text")).alias("s"))


@query("SELECT d.doc_id, b.item_id, contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) AS found FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id")
def f3_contains_quote(t):
    d = t.documents.withColumn("item_id", F.col("doc_id") % 40).withColumnRenamed("text", "t")
    return d.join(t.benchmark, "item_id").select("doc_id", "item_id", tx.contains_quote(F.col("t"), F.col("text")).alias("found"))


@query("SELECT d.doc_id, count(*) AS n_items, CAST(min(b.item_id) AS BIGINT) AS first_item FROM documents d JOIN benchmark b ON contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) GROUP BY 1")
def f3_contains_quote_all(t):
    """Every item against every whole text, where f3_contains_quote pairs each document with one item: the documents that
    contain any, found by joins on words and not by pairing each with each."""
    found = sp.find_quotes(t.benchmark, t.documents)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").cast("long").alias("first_item"))


@query("SELECT doc_id, len(string_split(text, 'the')) - 1 AS n, coalesce(instr(text, 'the') - 1, -1) AS first FROM documents")
def f4_find_all(t):
    hits = tx.find_all(F.col("text"), F.lit("the"))
    return t.documents.select("doc_id", hits.alias("h")).select("doc_id", F.size("h").alias("n"), F.coalesce(F.get("h", F.lit(0)), F.lit(-1)).cast("long").alias("first"))


@query("SELECT document_id, a, b, round(CASE WHEN least(a + 5, b + 9) > greatest(a, b) THEN (least(a + 5, b + 9) - greatest(a, b)) / 5e0 ELSE 0 END, 6) AS share FROM (SELECT l_orderkey AS document_id, l_partkey % 20 AS a, l_suppkey % 20 AS b FROM lineitem)")
def f5_overlap_share(t):
    x = t.lineitem.select(F.col("l_orderkey").alias("document_id"), (F.col("l_partkey") % 20).alias("a"), (F.col("l_suppkey") % 20).alias("b"))
    share = tx.overlap_share(F.col("a"), F.col("a") + 5, F.col("b"), F.col("b") + 9)
    return x.select("document_id", "a", "b", F.round(share + 1e-9, 6).alias("share"))


@query("""WITH q AS (SELECT item_id, '"' || trim(text) || '"' AS q FROM benchmark) SELECT item_id, array_to_string(list_distinct_order, '|') AS forms FROM (SELECT item_id,
 [x for x in list_distinct([q]) ] AS z, list_filter([q, regexp_replace(substr(q, 2, length(q) - 2), '[.;:,]+$', ''), CASE WHEN regexp_replace(substr(q, 2, length(q) - 2), '[.;:,]+$', '') <> substr(q, 2, length(q) - 2) THEN substr(q, 2, length(q) - 2) END], lambda x: x IS NOT NULL) AS list_distinct_order
 FROM (SELECT item_id, regexp_replace(q, '\\s+', ' ', 'g') AS q FROM q))""")
def f6_strip_quote_forms(t):
    q = F.concat(F.lit('"'), F.trim("text"), F.lit('"'))
    return t.benchmark.select("item_id", F.concat_ws("|", tx.strip_quote_forms(q)).alias("forms"))


@query(f"SELECT doc_id, line_no, trim(regexp_replace(lower(line), '[0-9]+', '#', 'g')) AS masked FROM ({_LINES})")
def f7_mask_digits(t):
    return lines(t).select("doc_id", "line_no", tx.mask_digits(F.col("line")).alias("masked"))


@query("SELECT doc_id, replace(regexp_replace(replace(text, '.' || chr(10), '-' || chr(10)), '-\\n([a-zà-öø-ÿß])', '\\1', 'g'), chr(10), ' ') AS joined FROM documents")
def f8_repair_hyphenation(t):
    return t.documents.select("doc_id", tx.repair_hyphenation(F.replace(F.col("text"), F.lit(".\n"), F.lit("-\n"))).alias("joined"))


_FOOT = f"""SELECT doc_id, line_no, CASE (doc_id + line_no) % 7 WHEN 0 THEN line_no::VARCHAR WHEN 1 THEN 'Page  ' || doc_id WHEN 2 THEN line_no || ' of ' || doc_id WHEN 3 THEN doc_id || ' | ' || line WHEN 4 THEN left(line, 60) || ' / ' || line_no WHEN 5 THEN 'page ' || line ELSE line END AS line FROM ({_LINES})"""


@query(f"""WITH l AS (SELECT doc_id, line_no, lower(line) AS low, translate(line, '/', '|') AS bars FROM ({_FOOT})), c AS (SELECT *, string_split(replace(CASE WHEN regexp_matches(low, '^page\\s') THEN ltrim(substr(low, 5)) ELSE low END, 'of', '/'), '/') AS parts,
 split_part(bars, '|', 1) AS head, split_part(bars, '|', -1) AS tail FROM l)
SELECT doc_id, line_no FROM c WHERE (len(parts) <= 2 AND low = trim(low) AND len(list_filter(parts, lambda x: NOT regexp_full_match(trim(x), '\\d+'))) = 0)
 OR (contains(bars, '|') AND ((regexp_full_match(head, '\\d+\\s*') AND length(ltrim(substr(bars, length(head) + 2))) <= 40) OR (regexp_full_match(tail, '\\s*\\d+') AND length(rtrim(left(bars, length(bars) - length(tail) - 1))) <= 40)))""")
def f9_is_page_number(t):
    """Lines of the texts set as the foot of a page in several ways, right ones and wrong ones."""
    k = (F.col("doc_id") + F.col("line_no")) % 7
    n, d, x = F.col("line_no").cast("string"), F.col("doc_id").cast("string"), F.col("line")
    foot = F.when(k == 0, n).when(k == 1, F.concat(F.lit("Page  "), d)).when(k == 2, F.concat(n, F.lit(" of "), d)).when(k == 3, F.concat(d, F.lit(" | "), x)).when(k == 4, F.concat(F.substring(x, 1, 60), F.lit(" / "), n)).when(k == 5, F.concat(F.lit("page "), x)).otherwise(x)
    return lines(t).where(tx.is_page_number(foot)).select("doc_id", "line_no")


@query("SELECT doc_id, trim(regexp_replace(replace(replace(lower(text), '.', ' and '), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g')) AS label FROM documents")
def f10_fold_label(t):
    return t.documents.select("doc_id", tx.fold_label(F.replace(F.col("text"), F.lit("."), F.lit("&"))).alias("label"))


@query()
def f10_fold_label_all(t):
    return t.documents.select("doc_id", tx.fold_label(F.replace(F.col("text"), F.lit("."), F.lit("&"))).alias("label"))


@query("""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'its', 'their', 'for', 'with', 'that'))) AS n FROM documents""")
def f11_content_words(t):
    return t.documents.select("doc_id", F.size(tx.content_words(F.col("text"))).alias("n"))


@query("SELECT o_orderkey, DATE '1998-12-31' - CAST(o_orderdate AS DATE) AS days FROM orders")
def f12_days_between(t):
    return t.orders.select("o_orderkey", tx.days_between(F.col("o_orderdate").cast("date"), F.lit("1998-12-31").cast("date")).cast("long").alias("days"))


@query("SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS stamp FROM orders")
def f13_archive_stamp(t):
    from ..operators.company import archive_stamp

    url = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://archive.example/web/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000/http://x.example/"))).otherwise("http://x.example/")
    return t.orders.select(F.col("o_orderkey").alias("document_id"), archive_stamp(url).cast("string").alias("stamp"))


@query("""SELECT o_orderkey AS document_id, CAST(CASE WHEN o_orderkey % 3 = 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 61 >= 30) THEN CAST(o_orderdate AS DATE)
 WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 61 AS INT) END AS VARCHAR) AS date, CASE WHEN o_orderkey % 3 = 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 61 >= 30) THEN 'archive' WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'retrieved' END AS basis FROM orders""")
def p16_document_date(t):
    from ..operators.company import document_date

    url = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://archive.example/web/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000/http://x.example/"))).otherwise("http://x.example/")
    got = F.when(F.col("o_orderkey") % 5 != 0, F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 61).cast("int")).cast("string"))
    x = document_date(F.lit(None).cast("string"), url, got)
    return t.orders.select(F.col("o_orderkey").alias("document_id"), x.alias("x")).select("document_id", F.col("x.date").cast("string").alias("date"), "x.basis")


@query("SELECT event_id, abs(value - round(value)) <= greatest(0.05e0, abs(value) * 0.005e0) AS near FROM events")
def f14_close_enough(t):
    return t.events.select("event_id", tx.close_enough(F.col("value"), F.round("value")).alias("near"))


@query()
def f14_close_enough_all(t):
    return t.events.select("event_id", tx.close_enough(F.col("value"), F.round("value")).alias("near"))


@query("""WITH e AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE value IS NOT NULL),
s AS (SELECT event_id, v, replace(CASE event_id % 4 WHEN 0 THEN 'It fell ' || format('{:,}', v) || '% in a year' WHEN 1 THEN v || '.0 tonnes' WHEN 2 THEN 'id 9' || v || '1 no' ELSE 'from ' || (v + event_id % 3 - 1) || '.00 on' END, ',', '') AS x FROM e)
SELECT event_id, regexp_matches(' ' || x || ' ', '[^\\d.]' || abs(v) || '(\\.00?)?[^\\d]') AS stated FROM s""")
def f15_states_value(t):
    """Numbers of the events in sentences of four forms, right and wrong ones."""
    v = F.round(F.col("value") * 100).cast("long")
    k, s = F.col("event_id") % 4, v.cast("string")
    near = (v + F.col("event_id") % 3 - 1).cast("string")
    sentence = F.when(k == 0, F.concat(F.lit("It fell "), F.format_number(v, 0), F.lit("% in a year"))).when(k == 1, F.concat(s, F.lit(".0 tonnes"))).when(k == 2, F.concat(F.lit("id 9"), s, F.lit("1 no"))).otherwise(F.concat(F.lit("from "), near, F.lit(".00 on")))
    return t.events.where("value is not null").select("event_id", tx.states_value(sentence, -v.cast("double")).alias("stated"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN b = 0 THEN NULL ELSE round(a / b * 100, 6) END WHEN 'view' THEN CASE WHEN a = 0 THEN NULL ELSE round((b - a) / a * 100, 6) END
 WHEN 'signup' THEN CASE WHEN b = 0 THEN NULL ELSE round(a / b, 6) END ELSE CASE WHEN a + b = 0 THEN NULL ELSE round(a / (a + b) * 100, 6) END END AS value FROM (SELECT *, (event_id % 50)::DOUBLE AS a, (event_id % 7)::DOUBLE AS b FROM events)""")
def f16_recompute(t):
    m = F.create_map(*[F.lit(x) for kv in {"click": "share", "view": "change", "signup": "pace"}.items() for x in kv])
    inputs = F.create_map(F.lit("a"), (F.col("event_id") % 50).cast("double"), F.lit("b"), (F.col("event_id") % 7).cast("double"))
    return t.events.select("event_id", F.round(tx.recompute(F.coalesce(m[F.col("event_type")], F.lit("split")), inputs) + 1e-9, 6).alias("value"))


@query("""SELECT event_id, CASE WHEN b = 0 THEN 'undefined' WHEN event_id % 3 = 1 THEN 'different_value' WHEN event_id % 3 = 2 THEN 'not_stated' END AS reject FROM (SELECT event_id, event_id % 7 AS b FROM events)""")
def f17_checked_computation(t):
    a, b = (F.col("event_id") % 50 + 10).cast("double"), (F.col("event_id") % 7).cast("double")
    value = F.coalesce(F.try_divide(a, b) * 100, F.lit(0.0))
    sentence = F.when(F.col("event_id") % 3 == 2, "It fell.").otherwise(F.concat(F.lit("It is "), F.format_string("%.2f", value), F.lit("%")))
    x = tx.checked_computation(F.lit("share"), F.create_map(F.lit("a"), a, F.lit("b"), b), F.when(F.col("event_id") % 3 == 1, value + 50).otherwise(value), sentence)
    return t.events.select("event_id", x["reject"].alias("reject"))


def _fronted_sql(fronts):
    """SQL of the lines of all texts with one of ``fronts`` before each, by place."""
    n = len(fronts)
    return f"SELECT doc_id, line_no, CASE (doc_id + line_no) % {n} " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(fronts)) + f" END || line AS x FROM ({_LINES})"


def _fronted(fronts):
    k, front = (F.col("doc_id") + F.col("line_no")) % len(fronts), F.lit("")
    for i, f in enumerate(fronts):
        front = F.when(k == i, f).otherwise(front)
    return F.concat(front, "line")


_HEADS = ("Notes ", "Notebook ", "NOTES: ", "Forward-looking statements ", "Forward thinking ", "Disclaimer", "References", "Our references ", "End notes ", "Legal notice of ", "Legal team ", "")
_MARKS = ("- ", "-", "* ", "• ", "## ", "##", "###### ", "####### ", "  - ", "")


@query(f"""WITH t AS ({_fronted_sql(_HEADS)}) SELECT doc_id, line_no, CASE WHEN regexp_matches(lower(x), '^({'|'.join(tx.NOTE_HEADINGS)})([^a-z0-9_]|$)') THEN 'footnote' WHEN {' OR '.join(f"starts_with(lower(x), '{p}')" for p in tx.CAUTION_HEADINGS)} THEN 'cautionary' END AS class FROM t""")
def f18_heading_class(t):
    return lines(t).select("doc_id", "line_no", tx.heading_class(_fronted(_HEADS)).alias("class"))


@query(f"""WITH t AS ({_fronted_sql(_MARKS)}) SELECT doc_id, line_no, left(x, 1) IN ('-', '*', '•', '‣', '◦', '▪') AND substr(x, 2, 1) = ' ' AND trim(substr(x, 2)) <> '' AS bullet,
 CASE WHEN n BETWEEN 1 AND 6 AND substr(x, n + 1, 1) = ' ' AND trim(substr(x, n + 1)) <> '' THEN n ELSE 0 END AS level FROM (SELECT *, CAST(length(x) - length(ltrim(x, '#')) AS INT) AS n FROM t)""")
def f19_marked_lines(t):
    text = _fronted(_MARKS)
    return lines(t).select("doc_id", "line_no", tx.is_bullet(text).alias("bullet"), tx.heading_level(text).alias("level"))


_ENDS_OF_TITLE = ("", " | Site", " - part", " - part - Site", " – Site", " — a | b", " - a — b – c")


@query("WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDS_OF_TITLE)) + " END AS x FROM pages) SELECT page_id, CASE "
       + " ".join(f"WHEN contains(x, '{sep}') THEN regexp_extract(x, '(?s)^(.*){sep.replace('|', '[|]')}', 1)" for sep in (" | ", " - ", " – ", " — ")) + " ELSE x END AS title FROM t")
def f20_short_title(t):
    """Titles of the pages with a site's name or parts behind them."""
    end = F.lit("")
    for i, e in enumerate(_ENDS_OF_TITLE):
        end = F.when(F.col("page_id") % 7 == i, e).otherwise(end)
    title = F.concat(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), end)
    return t.pages.select("page_id", tx.short_title(title).alias("title"))


@query("SELECT event_id, 'C' || x AS claim FROM (SELECT event_id, unnest(range(0, event_id % 4)) AS x FROM events WHERE event_id % 5 <> 0)")
def f21_json_arrays(t):
    items = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("event_id") % 4), lambda i: F.concat(F.lit("C"), i.cast("string")))
    reply = F.when(F.col("event_id") % 5 == 0, "no object here").otherwise(F.concat(F.lit("Here it is:\n"), F.to_json(F.struct(items.alias("claims"))), F.lit("\nOr {as \"}\" said}: "), F.to_json(F.struct(F.array(F.lit("other")).alias("claims")))))
    return t.events.select("event_id", F.explode(tx.json_arrays(reply, "claims array<string>")["claims"]).alias("claim"))


def _entities(c):
    """SQL that resolves the entities of the pages' prose, the ampersand last."""
    for name, char in (("&copy;", "'©'"), ("&middot;", "'·'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        c = f"replace({c}, '{name}', {char})"
    return c


def _shown(c):
    """SQL of the visible text: hidden elements go, each tag that makes a block is a line break, other tags vanish."""
    for tag in tx.HIDDEN_TAGS:
        c = f"regexp_replace({c}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    blocks = "|".join(tx.BLOCK_TAGS)
    return _entities(f"regexp_replace(regexp_replace({c}, '(?i)<\\s*/?\\s*({blocks})(\\s[^>]*|/[^>]*)?>', chr(10), 'g'), '<[^>]+>', '', 'g')")


@query(f"SELECT page_id, {_shown('html')} AS text FROM pages")
def s14_visible_text(t):
    return t.pages.select("page_id", tx.visible_text(F.col("html")).alias("text"))


_HEAD = """CASE page_id % 4 WHEN 0 THEN '<meta property="og:site_name" content="Site ' || page_id || '">' WHEN 1 THEN '<meta name="date" content="2024-01-0' || page_id % 9 || '"><link rel="canonical" href="http://c.example/' || page_id || '">'
 WHEN 2 THEN '<script type="application/ld+json">{"publisher": {"name": "House ' || page_id || '"}, "datePublished": "2023-02-0' || page_id % 7 || '"}</script>' ELSE '' END || html"""


def _meta(pattern):
    return f"nullif(trim(regexp_replace(regexp_replace(regexp_extract(h, '{pattern}', 1), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')), '')"


def _named(name):
    return _meta(f'(?is)<meta[^>]*(?:property|name)="{name}"[^>]*content="([^"]*)"')


@query(f"""WITH p AS (SELECT page_id, url, {_HEAD} AS h FROM pages), x AS (SELECT *, TRY_CAST(regexp_extract(h, '(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>', 1) AS JSON) AS ld, string_split(regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', ''), '.') AS l FROM p),
y AS (SELECT *, CASE WHEN len(l) >= 3 AND length(l[-2]) <= 3 AND length(l[-1]) = 2 THEN l[-3] ELSE l[-2] END AS o FROM x)
SELECT page_id, {_meta('(?is)<html[^>]*\\blang="([^"]*)"')} AS language, coalesce({_meta('(?is)<title[^>]*>(.*?)</title>')}, {_named('og:title')}) AS title, {_meta('(?is)<h1[^>]*>(.*?)</h1>')} AS h1, {_named('og:site_name')} AS site_name,
 coalesce({_named('article:published_time')}, {_named('date')}, ld->>'$.datePublished') AS published, coalesce({_meta('(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"')}, url) AS canonical,
 coalesce(ld->>'$.publisher.name', ld->>'$.author.name', {_named('og:site_name')}, upper(left(o, 1)) || lower(substr(o, 2))) AS organisation FROM y""")
def s13_page_meta(t):
    """All fields, on the pages with a site name, a date and canonical link, or linked data in front."""
    i = F.col("page_id")
    d = lambda m: (i % m).cast("string")
    head = F.when(i % 4 == 0, F.concat(F.lit('<meta property="og:site_name" content="Site '), i.cast("string"), F.lit('">'))).when(
        i % 4 == 1, F.concat(F.lit('<meta name="date" content="2024-01-0'), d(9), F.lit('"><link rel="canonical" href="http://c.example/'), i.cast("string"), F.lit('">'))).when(
        i % 4 == 2, F.concat(F.lit('<script type="application/ld+json">{"publisher": {"name": "House '), i.cast("string"), F.lit('"}, "datePublished": "2023-02-0'), d(7), F.lit('"}</script>'))).otherwise("")
    return pg.page_meta(t.pages.withColumn("html", F.concat(head, "html")))


_BLOCKS = r"""WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>|<header\b.*?</header\s*>|<aside\b.*?</aside\s*>|<form\b.*?</form\s*>|<noscript\b.*?</noscript\s*>', ' ', 'g') AS h FROM pages),
e AS (SELECT page_id, regexp_extract_all(h, '(?is)<(?:h[1-6]|p|li|figcaption|caption|tr|title)\b[^>]*>.*?</(?:h[1-6]|p|li|figcaption|caption|tr|title)\s*>') AS b FROM c),
x AS (SELECT page_id, generate_subscripts(b, 1) - 1 AS pos, unnest(b) AS raw FROM e),
y AS (SELECT page_id, pos, lower(regexp_extract(raw, '^<([A-Za-z0-9]+)', 1)) AS tag, trim(regexp_replace(""" + _shown("raw") + r""", '\s+', ' ', 'g')) AS text FROM x)"""


@query(_BLOCKS + " SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS block_no, CASE WHEN tag = 'title' THEN 'title' WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'list_item' WHEN tag IN ('figcaption', 'caption') THEN 'caption' WHEN tag = 'tr' THEN 'table_row' ELSE 'paragraph' END AS kind, text FROM y WHERE text <> ''")
def s12_page_blocks(t):
    return pg.page_blocks(t.pages).select("page_id", "block_no", "kind", "text")


@query()
def s12_page_blocks_all(t):
    return pg.page_blocks(t.pages).select("page_id", "block_no", "kind", "text")


@query("""WITH l AS (SELECT DISTINCT d.source, d.doc_id, trim(regexp_replace(lower(x.line), '[0-9]+', '#', 'g')) AS k FROM documents d JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) x ON x.doc_id = d.doc_id),
n AS (SELECT source, count(DISTINCT doc_id) AS total FROM documents GROUP BY 1) SELECT l.source, k, count(*) AS n_docs FROM l JOIN n ON n.source = l.source WHERE k <> '' GROUP BY l.source, k, total HAVING count(*) >= CASE WHEN total <= 3 THEN 2 ELSE greatest(3, ceil(0.05 * total)) END""")
def a29_repeated_lines(t):
    return pg.repeated_lines(t.documents, "source", share=0.05)


@query("SELECT source AS company, doc_id AS document_id FROM documents WHERE length(text) > 0")
def s4_split_frontmatter(t):
    marked = F.concat(F.lit("---\ncompany: "), "source", F.lit("\nid: "), F.col("doc_id").cast("string"), F.lit("\n---\n"), "text")
    x = t.documents.select("text", tx.split_frontmatter(marked).alias("x"))
    return x.where((F.length("text") > 0) & (F.col("x.body") == F.col("text"))).select(F.col("x.meta")["company"].alias("company"), F.col("x.meta")["id"].cast("long").alias("document_id"))


@query("SELECT url_id, stamp FROM (SELECT *, lag(digest) OVER (PARTITION BY url_id ORDER BY stamp, digest) AS b FROM v_captures) WHERE b IS NULL OR b <> digest")
def w9_collapse_runs(t):
    return od.collapse_runs(t.v_captures, ["url_id"], [F.col("stamp"), F.col("digest")], "digest").select("url_id", "stamp")


@query("SELECT url_id, stamp FROM (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY stamp, digest) AS k, count(*) OVER (PARTITION BY url_id) AS n FROM v_captures) WHERE n <= 20 OR k <= 10 OR k > n - 10")
def w11_keep_ends(t):
    return od.keep_ends(t.v_captures, ["url_id"], [F.col("stamp"), F.col("digest")], 20).select("url_id", "stamp")


@query("""WITH u AS (SELECT url_id, strftime(stamp, '%Y%m%d%H%M%S') AS stamp, min(digest) AS digest FROM v_captures GROUP BY 1, 2), r AS (SELECT *, lag(digest) OVER (PARTITION BY url_id ORDER BY stamp) AS b FROM u), c AS (SELECT url_id, stamp, digest FROM r WHERE b IS NULL OR b <> digest)
SELECT url_id, stamp, digest FROM (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY stamp) AS k, count(*) OVER (PARTITION BY url_id) AS n FROM c) WHERE n <= 30 OR k <= 15 OR k > n - 15""")
def s10_capture_history(t):
    one = t.v_captures.groupBy("url_id", "stamp").agg(F.min("digest").alias("digest"))
    return pg.capture_history(one.select("url_id", F.date_format("stamp", "yyyyMMddHHmmss").alias("stamp"), "digest"), "url_id", 30)


@query("SELECT document_id, claim_id, ignored FROM (SELECT l_orderkey AS document_id, l_linenumber AS claim_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) - 1 AS ignored FROM lineitem) WHERE k = 1")
def w8_dedupe(t):
    out = od.dedupe(t.lineitem, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")])
    return out.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("claim_id"), "ignored")


@query("SELECT document_id, claim_id, 'C' || row_number() OVER (PARTITION BY document_id ORDER BY prominence DESC, claim_id) AS id FROM v_claims")
def w7_number_rows(t):
    return od.number_rows(t.v_claims, ["document_id"], [F.desc("prominence"), F.col("claim_id")], "C").select("document_id", "claim_id", "id")
