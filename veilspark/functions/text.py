"""Text rules as Column expressions (no Python runs per row)."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

from .charset import (
    ASCII_BOUNDARY,
    DOT,
    FOLD_FROM,
    FOLD_TO,
    LOWER_LETTER,
    WORD_LETTER,
    WS,
    WS_CHARS,
)

# ---- fixed values -----------------------------------------------------------
PAGE_MARKER = r"\[PAGE:\d+\]"
UNCERTAIN_MARK = r"(?iu)⚠️\[(НЕТОЧНО: [^\]]*|НЕЧИТАЕМО)\]"
UNREADABLE = "НЕЧИТАЕМО"
UNCERTAIN_PREFIX = "НЕТОЧНО: "
ANALYSIS_LIMIT = 25000
LEGAL_HEADING = (
    r"(?iu)(УСТАНОВИЛ|ПОСТАНОВИЛ|РЕШИЛ|ОПРЕДЕЛИЛ|ПРИГОВОРИЛ|УСТАНОВИЛА|ПОСТАНОВИЛА|РЕШИЛА"
    r"|ОПРЕДЕЛИЛА|ПРИГОВОРИЛА|УСТАНОВИЛО|ПОСТАНОВИЛО)(?::|" + WS + ")"
)
LEGAL_HEADING_MAX = 60
BOLD_SECTION = r"^\*\*(УСТАНОВИЛ|ПОСТАНОВИЛ|РЕШИЛ|ОПРЕДЕЛИЛ|ПРИГОВОРИЛ)(?:[:*]|" + WS + ")"
# Named character references met in page HTML.
ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&nbsp;": " ",
    "&amp;": "&",
}
# ---- end of fixed values ----------------------------------------------------


# Names of character references beyond the common ones, and what numbers 128 to
# 159 stand for: both from the standard library's tables.
_NAMED = json.dumps({name: char for name, char in html5.items() if name.endswith(";")})
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_C1_SHOWN = "".join(bytes([b]).decode("cp1252", "replace").replace("\ufffd", chr(b)) for b in range(0x80, 0xA0))


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_trim(s: Column | str) -> Column:
    """Strip white space on both sides; linear in the text length."""
    return F.btrim(as_col(s), F.lit(WS_CHARS))


def js_rtrim(s: Column | str) -> Column:
    return F.rtrim(as_col(s), F.lit(WS_CHARS))


def is_blank(s: Column | str) -> Column:
    return js_trim(s) == ""


def fold_case(s: Column | str) -> Column:
    """Case folding that agrees with case-insensitive matching, char by char."""
    s = as_col(s)
    rare = F.translate(F.lower(F.translate(s, "İ", "i")), FOLD_FROM, FOLD_TO)
    return F.when(s.rlike(f"[İ{FOLD_FROM}]"), rare).otherwise(F.lower(s))


def normalize_pd_text(s: Column | str) -> Column:
    """Null becomes '', runs of white space become one blank, ends are trimmed."""
    return js_trim(F.regexp_replace(F.coalesce(as_col(s), F.lit("")), WS + "+", " "))


def dehyphenate(s: Column | str) -> Column:
    """Join words split by a hyphen at a line end or before a stray blank."""
    joined = F.regexp_replace(as_col(s), f"({WORD_LETTER})-\\r?\\n({LOWER_LETTER})", "$1$2")
    return F.regexp_replace(joined, f"({WORD_LETTER})- ({LOWER_LETTER})", "$1$2")


def strip_page_markers(s: Column | str) -> Column:
    return F.regexp_replace(as_col(s), PAGE_MARKER, "")


def split_pages(s: Column | str) -> Column:
    """array<struct<page_no: bigint, text: string>>; text ahead of the first
    marker is a page without number and is kept only when it is not blank."""
    s = as_col(s)
    numbers = F.concat(
        F.array(F.lit(None).cast("string")),
        F.regexp_extract_all(s, F.lit(r"\[PAGE:(\d+)\]"), F.lit(1)),
    )
    bodies = F.split(s, PAGE_MARKER, -1)
    pages = F.zip_with(
        numbers,
        bodies,
        lambda n, t: F.struct(n.try_cast("bigint").alias("page_no"), t.alias("text"), n.isNotNull().alias("m")),
    )
    kept = F.filter(pages, lambda p: p["m"] | ~is_blank(p["text"]))
    return F.transform(kept, lambda p: F.struct(p["page_no"], p["text"]))


def drop_page_number_lines(s: Column | str) -> Column:
    """Remove lines that hold nothing but one to three digits, then trim."""
    keep = F.filter(F.split(as_col(s), "\n", -1), lambda line: ~js_trim(line).rlike(r"\A[0-9]{1,3}\z"))
    return js_trim(F.array_join(keep, "\n"))


def clean_page(s: Column | str) -> Column:
    """Recognition clean-up of one page: joined hyphens, no page-number lines."""
    return drop_page_number_lines(dehyphenate(s))


def analysis_window(s: Column | str, limit: int = ANALYSIS_LIMIT) -> Column:
    plain = strip_page_markers(s)
    return F.when(
        F.length(plain) > limit, F.concat(F.substring(plain, 1, limit), F.lit("\n..."))
    ).otherwise(plain)


def is_long_text(s: Column | str, limit: int = ANALYSIS_LIMIT) -> Column:
    return F.length(strip_page_markers(F.coalesce(as_col(s), F.lit("")))) > limit


def rewrite_hits(s: Column, pattern: Column | str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace each hit of ``pattern`` by ``rewrite(hit)`` inside the row."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits = F.transform(F.regexp_extract_all(s, pattern, F.lit(0)), rewrite)
    gaps = F.split(s, pattern, -1)
    return F.array_join(
        F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), ""
    )


def collapse_repeated_words(s: Column | str) -> Column:
    # letters and white space exclude each other, so no run gives anything back
    pattern = f"(?iu){ASCII_BOUNDARY}({WORD_LETTER}{{4,}}+){WS}++\\1{ASCII_BOUNDARY}"
    return F.regexp_replace(as_col(s), pattern, "$1")


def fold_uncertain_echo(s: Column | str) -> Column:
    """Drop a word that is repeated by the uncertain-reading mark behind it."""
    # letters and white space exclude each other, so no run gives anything back,
    # and a hit never starts inside a word (the hit before ends at a bracket)
    pattern = f"(?iu)(?<!{WORD_LETTER})({WORD_LETTER}{{2,}}+){WS}++⚠️\\[НЕТОЧНО:{WS}*([А-яЁёa-zA-Z| ]+)\\]"

    def settle(hit: Column) -> Column:
        parts = F.struct(F.regexp_extract(hit, pattern, 1).alias("word"), F.regexp_extract(hit, pattern, 2).alias("inner"))
        return let(parts, lambda x: let(js_trim(F.element_at(F.split(x["inner"], "\\|", -1), 1)), lambda first: folded(hit, x, first)))

    def folded(hit: Column, x: Column, first: Column) -> Column:
        root = F.least(F.lit(5), F.length(x["word"]), F.length(first))
        same = F.lower(F.left(x["word"], root)) == F.lower(F.left(first, root))
        return F.when(same, F.concat(F.lit("⚠️[НЕТОЧНО: "), x["inner"], F.lit("]"))).otherwise(hit)

    s = as_col(s)
    return F.when(F.contains(s, F.lit("⚠️[")), rewrite_hits(s, pattern, settle)).otherwise(s)


def tidy_raw_text(s: Column | str) -> Column:
    """Order matters: echoes first, then doubled words."""
    return collapse_repeated_words(fold_uncertain_echo(s))


def uncertain_parts(hit: Column) -> Column:
    """struct<kind, word, suggestion> of one uncertain-reading mark."""
    inner = F.substring(hit, F.lit(4), F.length(hit) - 4)
    at = F.instr(inner, UNCERTAIN_PREFIX)
    content = F.when(
        at > 0,
        F.concat(F.substring(inner, F.lit(1), at - 1), F.substring(inner, at + len(UNCERTAIN_PREFIX), F.length(inner))),
    ).otherwise(inner)
    cells = F.split(content, "\\|", -1)
    unreadable = inner == UNREADABLE
    return F.struct(
        F.when(unreadable, "unreadable").otherwise("uncertain").alias("kind"),
        F.when(unreadable, f"[{UNREADABLE}]").otherwise(js_trim(F.element_at(cells, 1))).alias("word"),
        F.when(unreadable, "")
        .otherwise(F.coalesce(js_trim(F.try_element_at(cells, F.lit(2))), F.lit("")))
        .alias("suggestion"),
    )


def extract_uncertain(s: Column | str) -> Column:
    """array<struct<kind, word, suggestion>> in text order."""
    return F.transform(F.regexp_extract_all(as_col(s), F.lit(UNCERTAIN_MARK), F.lit(0)), uncertain_parts)


def resolve_uncertain(s: Column | str, mode: str = "suggestion") -> Column:
    """Replace every mark by its suggestion (when it has one) or by its word."""
    if mode not in ("suggestion", "word"):
        raise ValueError(f"unknown mode: {mode}")

    def settle(hit: Column) -> Column:
        parts = uncertain_parts(hit)
        if mode == "word":
            return parts["word"]
        return F.coalesce(F.nullif(parts["suggestion"], F.lit("")), parts["word"])

    return rewrite_hits(as_col(s), UNCERTAIN_MARK, settle)


def is_special_line(trimmed: Column) -> Column:
    """Lines that neither join the line before nor accept the line behind."""
    return (
        (trimmed == "")
        | trimmed.startswith("## ")
        | trimmed.startswith("### ")
        | (trimmed == "---")
        | trimmed.rlike(r"\A\[PAGE:[0-9]+\]\z")
        | trimmed.startswith("[CENTER]")
        | trimmed.startswith("[LEFTRIGHT:")
        | trimmed.startswith("[RIGHT-BLOCK]")
        | trimmed.startswith("[INDENT]")
        | trimmed.rlike(BOLD_SECTION)
    )


def becomes_special(trimmed: Column) -> Column:
    """Heads that are no structural line, but one as soon as text is glued to
    them behind a blank."""
    return trimmed.isin("##", "###") | F.concat(trimmed, F.lit(" ")).rlike(BOLD_SECTION) & ~trimmed.rlike(BOLD_SECTION)


_INDENT = rf"\A\[INDENT\]({DOT}+)\z"
_RIGHT = rf"\A\[RIGHT-BLOCK\]({DOT}+)\z"
_CENTER = rf"\A\[CENTER\]({DOT}+?)\[/CENTER\]\z"
_LEFT_RIGHT = rf"\A\[LEFTRIGHT:{WS}*({DOT}+?){WS}*\|{WS}*({DOT}+?){WS}*\]\z"
_PAGE = r"\A\[PAGE:([0-9]+)\]\z"


def classify_line(s: Column | str) -> Column:
    """struct<kind, body, extra>; the first rule that applies wins."""
    s = as_col(s)
    plain = js_trim(F.replace(s, F.lit("**"), F.lit("")))
    legal = plain.rlike(LEGAL_HEADING) & (F.length(plain) < LEGAL_HEADING_MAX)

    def row(kind: str, body: Column, extra: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            body.alias("body"),
            (F.lit("") if extra is None else extra).alias("extra"),
        )

    return (
        F.when(s.startswith("## "), row("h2", F.substring(s, F.lit(4), F.length(s))))
        .when(s.startswith("### "), row("h3", F.substring(s, F.lit(5), F.length(s))))
        .when(s == "---", row("divider", F.lit("")))
        .when(is_blank(s), row("blank", F.lit("")))
        .when(s.rlike(_PAGE), row("page", F.regexp_extract(s, _PAGE, 1)))
        .when(s.rlike(_INDENT), row("indent", F.regexp_extract(s, _INDENT, 1)))
        .when(s.rlike(_RIGHT), row("right-block", F.regexp_extract(s, _RIGHT, 1)))
        .when(s.rlike(_CENTER), row("center", F.regexp_extract(s, _CENTER, 1)))
        .when(
            s.rlike(_LEFT_RIGHT),
            row("left-right", F.regexp_extract(s, _LEFT_RIGHT, 1), F.regexp_extract(s, _LEFT_RIGHT, 2)),
        )
        .when(legal, row("legal-heading", plain))
        .otherwise(row("paragraph", s))
    )


def classify_paragraph(
    text: Column, style: Column, align: Column, left: Column, first_line: Column, bold_runs: Column, runs: Column
) -> Column:
    """Marked-up line for an office paragraph described by its attributes."""
    body = js_trim(F.coalesce(text, F.lit("")))
    bold = (F.coalesce(runs, F.lit(0)) > 0) & (bold_runs > runs / 2)
    strong = F.concat(F.lit("**"), body, F.lit("**"))
    centred = F.coalesce(align, F.lit("left")) == "center"
    return (
        F.when(body == "", "")
        .when(style.isin("Heading1", "1"), F.concat(F.lit("## "), body))
        .when(bold & centred, F.concat(F.lit("[CENTER]"), strong, F.lit("[/CENTER]")))
        .when(centred, F.concat(F.lit("[CENTER]"), body, F.lit("[/CENTER]")))
        .when(F.coalesce(left, F.lit(0)) > 3000, F.concat(F.lit("[RIGHT-BLOCK]"), F.when(bold, strong).otherwise(body)))
        .when(bold, strong)
        .when(F.coalesce(first_line, F.lit(0)) > 300, F.concat(F.lit("[INDENT]"), body))
        .otherwise(body)
    )


def tab_line(left: Column, right: Column) -> Column:
    """Two-column line when both halves around a tab hold text."""
    left, right = js_trim(left), js_trim(right)
    return (
        F.when((left != "") & (right != ""), F.concat(F.lit("[LEFTRIGHT: "), left, F.lit(" | "), right, F.lit("]")))
        .when(left != "", left)
        .otherwise(right)
    )


def table_row_text(cells: Column) -> Column:
    """Non-empty trimmed cells joined by a bar; null when none is left."""
    kept = F.filter(F.transform(cells, js_trim), lambda c: c != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, " | "))


def collapse_blank_lines(s: Column | str) -> Column:
    return js_trim(F.regexp_replace(as_col(s), "\n{3,}", "\n\n"))


def escape_html(s: Column | str) -> Column:
    out = as_col(s)
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def bold_to_strong(s: Column | str) -> Column:
    return F.regexp_replace(as_col(s), r"\*\*([^*]+)\*\*", "<strong>$1</strong>")


def html_to_text(s: Column | str, skip_marks: bool = False) -> Column:
    """Text content: script/style subtrees, comments and tags go, references
    are decoded. ``skip_marks`` also drops mark subtrees (never annotated)."""
    out = as_col(s)
    tags = ["script", "style"] + (["mark"] if skip_marks else [])
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}{WS}*>", "")
    out = F.regexp_replace(out, r"(?s)<[!/?A-Za-z][^>]*>", "")
    return decode_references(out)


def decode_references(s: Column | str) -> Column:
    """Character references (named, decimal, hexadecimal; closed by a
    semicolon) decoded in one pass, so that what a reference yields is not read
    again. Numbers that are no character give U+FFFD, numbers 128 to 159 what
    Windows-1252 has there; unknown names stay as they are."""
    def decoded(hit: Column) -> Column:
        digits = F.regexp_extract(hit, "^&#0*([0-9]*);$", 1)
        hexes = F.regexp_extract(hit, "^&#[xX]0*([0-9a-fA-F]*);$", 1)
        is_hex = hit.rlike("^&#[xX]")
        code = F.when(is_hex & (F.length(hexes) <= 6), F.conv(F.concat(F.lit("0"), hexes), 16, 10).cast("bigint")).when(
            ~is_hex & (F.length(digits) <= 7), F.concat(F.lit("0"), digits).cast("bigint")
        )
        sound = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(F.coalesce(sound, F.lit(False)), code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        named = F.lit(None).cast("string")
        for name, value in ENTITIES.items():
            named = F.when(hit == name, F.lit(value)).otherwise(named)
        further = F.element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), F.substring(hit, 2, F.length(hit)))
        return F.when(hit.startswith("&#"), F.translate(char, _C1, _C1_SHOWN)).otherwise(F.coalesce(named, further, hit))

    return rewrite_hits(as_col(s), r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", decoded)


def extract_pd_ids(html: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(as_col(html), F.lit(r'data-pd-id="([^"]+)"'), F.lit(1)))


def export_spans(html: Column | str) -> Column:
    """Editor marks become plain export spans; page separators are dropped."""
    out = F.regexp_replace(
        as_col(html),
        r'(?s)<div class="page-separator"[^>]*>(?:<span[^>]*>[^<]*</span>)*</div>',
        "",
    )
    out = F.regexp_replace(out, r'<mark class="pd[^"]*"[^>]*>', '<span class="pd-export">')
    out = F.regexp_replace(out, r'<mark class="uncertain[^"]*"[^>]*>', '<span class="uncertain-export">')
    return F.replace(out, F.lit("</mark>"), F.lit("</span>"))


def source_file_key(name: Column, size: Column, modified: Column) -> Column:
    return F.concat_ws("::", name, size.cast("string"), modified.cast("string"))


def sanitize_file_name(name: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(F.nullif(as_col(name), F.lit("")), F.lit("file")), "[^a-zA-Z0-9._-]+", "_")


def base_title(name: Column | str) -> Column:
    """Title without a known file ending, the endings tried one after another."""
    out = as_col(name)
    for ending in ("pdf", "docx", "jpg", "png", "webp"):
        out = F.regexp_replace(out, rf"(?i)\.{ending}\z", "")
    return out
