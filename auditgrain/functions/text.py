"""Text functions as Columns; all are built-in expressions but NFC."""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# fixed values: characters a reader does not see, and white space beyond ASCII
INVISIBLE = "​‌‍⁠﻿­"
SPACE = r"[\s\u0085   -     　\x1c-\x1f]"
# fixed values: one-to-one typographic replacements (of quotes for checks; of spans, length kept)
SQUASH_FROM, SQUASH_TO = "‘’“”–— ", "''\"\"-- "
NORMAL_FROM, NORMAL_TO = "‘’‚‛“”„‟–—−‐ ", "''''\"\"\"\"---- "
# fixed values: letters that decomposition does not fold
TRANSLITERATE = {"ø": "o", "Ø": "O", "æ": "ae", "Æ": "ae", "å": "a", "Å": "A", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ß": "ss", "þ": "th", "ð": "d"}
# fixed values: words that content words leave out
STOP_WORDS = ("the", "a", "an", "of", "and", "or", "in", "on", "its", "their", "for", "to", "s", "at", "by", "with", "that")
# fixed values: elements that the HTML standard's rendering section displays as blocks, list items or parts of tables, and line breaks
BLOCK_TAGS = (
    "html", "body", "address", "blockquote", "center", "dialog", "div", "figure", "figcaption", "footer", "form", "header", "hr", "legend", "listing", "main", "p", "plaintext", "pre", "search", "xmp",
    "article", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "nav", "section", "dir", "dd", "dl", "dt", "menu", "ol", "ul", "li",
    "table", "caption", "colgroup", "col", "thead", "tbody", "tfoot", "tr", "td", "th", "details", "summary", "fieldset", "optgroup", "option", "br",
)
# fixed values: elements whose content is never shown
HIDDEN_TAGS = ("script", "style", "noscript", "template")
# fixed values: how headings of notes, and of cautionary sections, begin
NOTE_HEADINGS = ("footnote", "footnotes", "foot note", "foot notes", "notes", "endnote", "endnotes", "end note", "end notes", "references")
CAUTION_HEADINGS = (
    "cautionary note", "cautionary statement", "forward looking statement", "forward-looking statement", "disclaimer", "legal notice", "legal disclaimer", "safe harbor", "safe harbour",
)


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


_PAIRS = ArrayType(StructType([StructField("a", StringType()), StructField("b", StringType())]))
_MAP = StructType([StructField("src", StringType()), StructField("dst", StringType()), StructField("more", _PAIRS)])


def _folding(other: str):
    """A UDF of the distinct characters of a text that are not ASCII: ``src`` and ``dst`` for translate, and those that become several (``more``).

    NFKD without combining marks works character by character; what is not ASCII then becomes ``other``."""

    def one(x: str) -> str:
        flat = "".join(c if c.isascii() else other for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
        return other if other and flat and not flat.strip(other) else flat

    @F.pandas_udf(_MAP)
    def fold(odd: pd.Series) -> pd.DataFrame:
        flat = {x: one(x) for x in set("".join(odd.fillna("")))}
        rows = []
        for text in odd:
            known = sorted(((x, flat[x]) for x in text or ""), key=lambda p: len(p[1]) != 1)  # translate drops what has no partner: at the end
            rows.append(("".join(x for x, y in known if len(y) < 2), "".join(y for _, y in known if len(y) == 1), [{"a": x, "b": y} for x, y in known if len(y) > 1]))
        return pd.DataFrame(rows, columns=["src", "dst", "more"])

    return fold


_FOLD = {other: _folding(other) for other in ("", "-")}


def odd_characters(c: Column) -> Column:
    """The distinct characters of ``c`` that are not ASCII, as one string."""
    return F.array_join(F.array_distinct(F.split(F.regexp_replace(c, r"[\x00-\x7f]+", ""), "")), "")


def folded(c: Column, other: str) -> Column:
    """``c`` in ASCII: NFKD without combining marks, what is still not ASCII as ``other`` ("" or "-").

    Python sees the distinct characters beyond ASCII of each text only, never a text."""
    map_ = _FOLD[other](odd_characters(c))
    several = F.aggregate(map_["more"], c, lambda text, x: F.replace(text, x["a"], x["b"]))
    return F.call_function("translate", several, map_["src"], map_["dst"])


def nfc(c: Column, assume_composed: bool = False) -> Column:
    """NFC; the one function without a built-in.  ``assume_composed`` leaves it out for text known to be composed."""
    return c if assume_composed else F.when(c.rlike(r"[^\x00-\x7f]"), _nfc(c)).otherwise(c)


def canonical_line(c: Column, assume_composed: bool = False) -> Column:
    c = F.translate(nfc(c, assume_composed), INVISIBLE, "")
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def canonical_violations(c: Column) -> Column:
    """Names of the broken rules of canonical text, in order."""
    other = r"[\t\x0b\f\x1c-\x1f\u0085   -     　]"
    edge = c.rlike(rf"^{SPACE}|{SPACE}\z")
    return F.array_compact(F.array(
        F.when(F.coalesce(c, F.lit("")) == "", "empty"), F.when(c.contains("\r"), "carriage_return"), F.when(c.rlike(other), "other_whitespace"),
        F.when(c.contains("  "), "double_space"), F.when(c.contains(" \n") | c.contains("\n "), "space_at_line_edge"),
        F.when(c.contains("\n\n\n"), "blank_line_run"), F.when((F.length(c) > 0) & edge, "outer_whitespace"),
    ))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, SPACE + "+"), lambda x: x != ""))


def norm_url(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), "/+$", ""))


def host_of(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))), r"^www\.", "")


def org_from_host(url: Column) -> Column:
    """Second-level label of the host, past a short country second level; null under two labels."""
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    n = F.size(labels)
    at = lambda i: F.try_element_at(labels, F.lit(i))
    label = F.when((n >= 3) & (F.length(at(-2)) <= 3) & (F.length(at(-1)) == 2), at(-3)).when(n >= 2, at(-2))
    return F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, 2, 1000)))


def slug(*parts: Column, limit: int = 64) -> Column:
    raw = F.concat_ws("-", *(F.nullif(p, F.lit("")) for p in parts))
    out = F.regexp_replace(F.regexp_replace(F.lower(folded(raw, "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.regexp_replace(F.substring(out, 1, limit), "^$", "document"[:limit]), "[-.]+$", "")


def company_slug(c: Column) -> Column:
    for a, b in TRANSLITERATE.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(F.lower(folded(c, "-")), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def lenient_int(c: Column) -> Column:
    return F.replace(F.nullif(F.regexp_extract(c, r"(\d[\d,]*)", 1), F.lit("")), F.lit(","), F.lit("")).try_cast("long")


def is_web_url(c: Column) -> Column:
    return F.trim(c).rlike(r"^https?://[^\s/]+")


def squash(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.translate(c, SQUASH_FROM, SQUASH_TO), SPACE + "+", " ")))


def normalise(c: Column) -> Column:
    """Typographic characters to ASCII, length kept."""
    return F.translate(c, NORMAL_FROM, NORMAL_TO)


def contains_quote(text: Column, quote: Column) -> Column:
    return squash(text).contains(squash(quote))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often it is named there."""
    return F.transform(F.array(value), body)[0]


def _running_sums(sizes: Column, extra: Column) -> Column:
    """Sums of ``sizes`` (integers), each with ``extra``, before each entry and with its own size: where cut number i ends.

    In runs of about the square root of their number, so that growing arrays cost little for a long list too."""
    none = F.array().cast("array<int>")

    def sums(values: Column, start: Column, step: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(values, first, lambda a, x: F.struct((a["at"] + x + step).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out")))["out"]

    def cut(all_: Column, run: Column) -> Column:
        return F.when(F.size(all_) > 0, F.transform(F.sequence(F.lit(0), F.size(all_) - 1, run), lambda i: F.slice(all_, i + 1, run))).otherwise(F.array().cast("array<array<int>>"))

    def whole(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x + extra))
        return F.flatten(let(totals, lambda t: F.zip_with(runs, F.zip_with(sums(t, F.lit(0), F.lit(0)), t, lambda e, own: e - own), lambda r, before: sums(r, before, extra))))

    length = lambda all_: F.greatest(F.ceil(F.sqrt(F.size(all_).cast("double"))).cast("int"), F.lit(1))
    return let(sizes, lambda all_: let(length(all_), lambda run: let(cut(all_, run), whole)))


def running_ends(sizes: Column) -> Column:
    """Sums of ``sizes`` (integers) up to and with each entry: where each of several strings in a row ends."""
    return _running_sums(sizes, F.lit(0))


def find_all(text: Column, needle: Column) -> Column:
    """Offsets (from 0, in characters) of all occurrences, overlapping ones too.

    The text is cut at the needle; a cut misses an occurrence only if it overlaps the one before it, so, where a needle ends as
    it begins, places inside a found one are tested on their own.  A null or empty needle has none.  Text and needle are
    evaluated once: Spark would evaluate what they are made of again for every step of the lambdas."""
    return let(F.struct(text.alias("t"), needle.alias("q")), lambda x: _find_all(x["t"], x["q"]))


def _find_all(text: Column, needle: Column) -> Column:
    n = F.length(needle)
    parts = F.split(text, F.concat(F.lit(r"\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E")), -1)
    cuts = let(parts, lambda p: F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.length(x)))
    none = F.array().cast("array<int>")
    # distances at which the needle can overlap itself: what is left of it there is its own beginning
    steps = F.when(n > 1, F.filter(F.sequence(F.lit(1), n - 1), lambda j: F.substring(needle, j + 1, n) == F.substring(needle, F.lit(1), n - j))).otherwise(none)

    def with_inner(firsts: Column, steps: Column) -> Column:
        inside = F.flatten(F.transform(firsts, lambda s: F.transform(F.filter(steps, lambda j: F.substring(text, s + j + 1, n) == needle), lambda j: s + j)))
        return F.when(F.size(steps) > 0, F.array_sort(F.array_distinct(F.concat(firsts, inside)))).otherwise(firsts)

    return F.when(n > 0, let(_running_sums(cuts, n), lambda f: let(steps, lambda s: with_inner(f, s)))).otherwise(none)


def overlap_share(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over the shorter length."""
    inter = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    return F.try_divide(inter, F.least(a_end - a_start, b_end - b_start))


def strip_quote_forms(q: Column) -> Column:
    """Up to four forms to look for: without a final stop, as given, without quotation marks (and stop)."""
    q = F.trim(F.regexp_replace(q, SPACE + "+", " "))
    marks = "^[\"'“”‘’]+|[\"'“”‘’]+$"
    bare = F.regexp_replace(q, marks, "")
    stop = lambda x: F.regexp_replace(x, "[.;:,]+$", "")
    return F.filter(F.array_distinct(F.array(stop(q), q, stop(bare), bare)), lambda x: x != "")


def mask_digits(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"\d+", "#"))


def repair_hyphenation(text: Column) -> Column:
    """Lines joined by spaces; a hyphen at a line's end before a lower-case letter goes."""
    return F.regexp_replace(F.regexp_replace(text, r"-\n(?=\p{Ll})", ""), r"\n", " ")


def is_page_number(line: Column) -> Column:
    """A number alone, "page 3", "3 of 10", or a number set off by a bar or slash from a running title of up to 40 characters."""
    low = F.lower(line)
    counted = F.split(F.regexp_replace(low, r"^page\s+", ""), "of|/")
    numbers = F.forall(F.transform(counted, lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+$"))
    alone = (F.size(counted) <= 2) & numbers & ~low.rlike(r"^\s|\s$")
    bars = F.translate(line, "/", "|")
    left, right = F.substring_index(bars, "|", 1), F.substring_index(bars, "|", -1)
    after, before = F.substr(bars, F.length(left) + 2), F.substring(bars, F.lit(1), F.length(bars) - F.length(right) - 1)
    leads = left.rlike(r"^\d+\s*$") & (F.length(F.regexp_replace(after, r"^\s+", "")) <= 40)
    closes = right.rlike(r"^\s*\d+$") & (F.length(F.regexp_replace(before, r"\s+$", "")) <= 40)
    return alone | (bars.contains("|") & ~bars.contains("\n") & (leads | closes))


def fold_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9 ]+", " "))


def content_words(c: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    return F.filter(F.array_except(words, F.array(*map(F.lit, STOP_WORDS))), lambda w: F.length(w) > 2)


def days_between(earlier: Column, later: Column) -> Column:
    return F.datediff(later, earlier)


def close_enough(computed: Column, claimed: Column) -> Column:
    return F.abs(computed - claimed) <= F.greatest(F.lit(0.05), F.abs(computed) * 0.005)


def states_value(sentence: Column, value: Column) -> Column:
    """Whether a sentence states the number at 0, 1 or 2 decimals, standing alone; commas and sign aside."""
    plain = F.replace(sentence, F.lit(","), F.lit(""))
    tests = []
    for v in (value, F.abs(value)):
        for places in (0, 1, 2):
            text = F.format_string(f"%.{places}f", v)
            for form in {0: (text,), 1: (text, F.regexp_replace(text, r"\.0$", "")), 2: (text,)}[places]:
                tests.append(F.regexp_like(plain, F.concat(F.lit(r"(?<![\d.])"), F.replace(form, F.lit("."), F.lit(r"\.")), F.lit(r"(?!\d)"))))
    out = tests[0]
    for x in tests[1:]:
        out = out | x
    return out


def recompute(kind: Column, inputs: Column) -> Column:
    """share a/b, change from a to b, pace (a per b), split a/(a+b), in percent but for pace; null where undefined."""
    a, b = F.try_element_at(inputs, F.lit("a")), F.try_element_at(inputs, F.lit("b"))
    value = (
        F.when(kind == "share", F.try_divide(a, b) * 100).when(kind == "change", F.try_divide(b - a, a) * 100)
        .when(kind == "pace", F.try_divide(a, b)).when(kind == "split", F.try_divide(a, a + b) * 100)
    )
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def checked_computation(kind: Column, inputs: Column, claimed: Column, sentence: Column) -> Column:
    """(value, difference, reject): reject names the first failed check, null when it holds."""
    value = recompute(kind, inputs)
    reject = F.when(value.isNull(), "undefined").when(~close_enough(value, claimed), "different_value").when(~states_value(sentence, value), "not_stated")
    return F.struct(value.alias("value"), (value - claimed).alias("difference"), reject.alias("reject"))


def heading_class(c: Column) -> Column:
    """footnote or cautionary by how a heading begins; null for others."""
    low = F.lower(c)
    begins = lambda p: low.startswith(p)
    word = lambda p: low.startswith(p) & ~F.substring(low, len(p) + 1, 1).rlike(r"\w")
    note, caution = F.lit(False), F.lit(False)
    for p in NOTE_HEADINGS:
        note = note | word(p)
    for p in CAUTION_HEADINGS:
        caution = caution | begins(p)
    return F.when(note, "footnote").when(caution, "cautionary")


def is_bullet(c: Column) -> Column:
    return c.rlike("^[-*•‣◦▪]\\s+.*\\S\\s*$")


def heading_level(c: Column) -> Column:
    """Number of leading # of a marked heading; 0 for other lines."""
    return F.length(F.regexp_extract(c, r"^(#{1,6})\s+.*\S\s*$", 1))


def short_title(c: Column) -> Column:
    """A title without what follows the last of the first separator it has."""
    head = c
    for sep in reversed((" | ", " - ", " – ", " — ")):
        tail = F.length(F.substring_index(c, sep, -1)) + len(sep)
        head = F.when(c.contains(sep), F.substring(c, F.lit(1), F.length(c) - tail)).otherwise(head)
    return head


def json_arrays(reply: Column, schema: str) -> Column:
    """The first object of a model's reply, parsed; null where there is none that parses."""
    return F.from_json(first_object(reply), schema)


def first_object(reply: Column) -> Column:
    """The text from the first brace to the one that closes it; braces in strings don't count.  Null where none closes."""
    tail = F.when(F.instr(reply, "{") > 0, F.substr(reply, F.instr(reply, "{")))
    tokens = F.regexp_extract_all(tail, F.lit(r'(?s)("(?:[^"\\]|\\.)*+"|[{}]|[^"{}]++|")'), F.lit(1))
    step = lambda a, x: F.when(a["done"], a).otherwise(F.struct(
        (a["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)).alias("depth"), (a["at"] + F.length(x)).alias("at"), ((x == "}") & (a["depth"] == 1)).alias("done")))
    end = F.aggregate(tokens, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(False).alias("done")), step)
    return F.when(end["done"], F.substring(tail, F.lit(1), end["at"]))


def visible_text(html: Column) -> Column:
    """A page's text: block tags break lines, inline tags vanish, hidden elements go, entities are resolved."""
    c = html
    for tag in HIDDEN_TAGS:
        c = F.regexp_replace(c, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    c = F.regexp_replace(c, rf"(?i)<\s*/?\s*(?:{'|'.join(BLOCK_TAGS)})(?![A-Za-z0-9-])[^>]*>", "\n")
    return unescape(F.regexp_replace(c, "<[^>]+>", ""))


def unescape(c: Column) -> Column:
    """Named (HTML 4) and numeric entities resolved, each once; unknown ones stay."""
    entity = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
    names = F.create_map(*[F.lit(x) for name, code in ({"apos": 39} | name2codepoint).items() for x in (name, code)])

    def one(e: Column) -> Column:
        body = F.substring(e, F.lit(2), F.length(e) - 2)
        code = (
            F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 10), 16, 10).try_cast("int")).when(body.startswith("#"), F.substring(body, 2, 10).try_cast("int"))
            .otherwise(F.try_element_at(names, body))
        )
        good = (code > 0) & (code < 0x110000) & ((code < 0xD800) | (code > 0xDFFF))
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(e)

    found = F.transform(F.regexp_extract_all(c, F.lit(f"({entity})"), F.lit(1)), one)
    whole = F.zip_with(F.split(c, entity, -1), found, lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
    return F.when(c.contains("&"), F.array_join(whole, "")).otherwise(c)


def split_frontmatter(text: Column) -> Column:
    """(meta map, body): ``key: value`` lines between a first and a second ``---`` line; else all is body."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?\n)?---(?:\n|\z)", 0)
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":") & (x != "---"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    meta = F.map_from_entries(F.filter(pairs, lambda x: x["key"] != ""))
    return F.struct(F.when(head != "", meta).otherwise(F.map_from_entries(F.slice(pairs, 1, 0))).alias("meta"), F.substr(text, F.length(head) + 1).alias("body"))
