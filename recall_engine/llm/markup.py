"""Problem 1: markup residue in texts, and clean text that keeps headings, lists, code blocks and formulas.

Method: equivalence-class template deduction. The markup tokens of every record are found; across the records of one
host (the root of the path) tokens that share their occurrence vector form a class; classes whose tokens stand in one
order in every record are valid and nest into the host's template, and what is left between its tokens are the slots.
The kinds of a record are those of the classes it is in and of the markup in its slots; a record alone with its markup
has no template, it is one slot as a whole. What a text alone leaves open, an element or a placeholder in angle brackets,
is told by the class only: it is markup where a tag and its end are in one valid class.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recall_engine.llm.words import slices
from recall_engine.plans.tables import materialize, spread

#: Endings of source code, whose texts hold no markup.
CODE = ("py", "js", "sql", "sh")
#: Records a class of tokens must occur in to be a template.
SUPPORT = 3

_ATTRIBUTE = r"""(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))*(?:\s+[\w-]+)?"""
_TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9]{{0,15}})({_ATTRIBUTE})\s*/?>|<!DOCTYPE[^>]*>|<\?xml[^>]*>", re.I)
#: Tags of other names (x-card, o:p), which may as well be placeholders.
_OPEN = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9]*(?:[:._-][a-zA-Z0-9]+)*)({_ATTRIBUTE})\s*>")
_BOOLEAN = re.compile(r"(?:^|\s)(?:disabled|checked|selected|hidden|async|defer|required|readonly|multiple|controls|open|reversed|nowrap|noshade|compact)\s*$", re.I)
_ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
_FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})[^\n`]*\n(.*?)(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted|Verbatim)\*?\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?(.*?)\\end\{\1\*?\}", re.S)
_PRE = re.compile(r"(<(pre|code|syntaxhighlight|source|nowiki|samp|kbd)\b[^>]*>)(.*?)(</\2\s*>)", re.S | re.I)
_SILENT = re.compile(r"(<(script|style)\b[^>]*>)(.*?)(</\2\s*>)", re.S | re.I)

_HEADING = re.compile(r"^(#{1,6})[ \t]+(\S[^\n]*)$", re.M)
_UNDERLINED = re.compile(r"^(?=[^\n]*\w)(?![ \t]*[-*>|=#])([^\n]+)\n(={3,}|-{3,})[ \t]*$", re.M)
_MARKDOWN = [
    ("**", re.compile(r"\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*|\*\*\S\*\*")),
    ("*", re.compile(r"(?<![\w*\\/])\*(?=[^\s*/])[^*\n]*?[^\s*/]?(?<!\s)\*(?![\w*/])")),
    ("__", re.compile(r"(?<![\w._])__(?=[^\W_])[^_\n]*(?:_[^_\n]+)*[^\s_.]__(?![\w.(])")),
    ("_", re.compile(r"(?<![\w._/\\])_(?=[^\s_.])(?=[^_\n]*\w)[^_\n]*[^\s_]?_(?![\w._/])")),
    ("~~", re.compile(r"~~(?=[^\s~])[^~\n]*~~")),
    ("](", re.compile(r"!?\[[^\]\n]*\]\([^)\s]+(?:\s+\"[^\"\n]*\")?\)")),
    ("][", re.compile(r"\[[^\]\n]+\]\[[^\]\n]+\]")),
    ("`", re.compile(r"(?<!`)`[^`\n]+`(?!`)")),
    ("[^", re.compile(r"\[\^[^\]\s]+\]")),
    ("[", re.compile(r"^[ \t]*(?:[-*+]|\d+\.)[ \t]+\[[ xX]\][ \t]", re.M)),
    ("-|", re.compile(r"^[^\n]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*\|[ \t:|-]*$", re.M)),
    ("--|", re.compile(r"^[^\n]*\|[^\n]*\n[ \t]*(?:\|?[ \t]*:?-{2,}:?[ \t]*\|)+[ \t]*:?-{2,}:?[ \t]*\|?[ \t]*$", re.M)),
]
_WIKI = [
    ("=", re.compile(r"^(={1,6})[ \t]*[^=\s][^\n]*?[^=\s]?[ \t]*\1[ \t]*$", re.M)),
    ("''", re.compile(r"(?<!')(''|'''|''''')(?=[^'\s`])[^'\n`]*(?:'(?!')[^'\n`]*)*\1(?!')")),
    ("[[", re.compile(r"\[\[(?=[^\s\[\]-])[^\[\]\n]+\]\]")),
    ("[h", re.compile(r"(?<!\[)\[https?://[^\s\]]+(?:[ \t]+[^\]\n]*)?\](?!\()")),
    ("{{", re.compile(r"\{\{(?=[^\s{}])[^{}\n]*(?:\n[^{}\n]*)*\}\}")),
    ("{|", re.compile(r"^\{\|", re.M)),
]
_LATEX = [
    (re.compile(r"\\(?:begin|end)\s*\{[a-zA-Z]+\*?\}")),
    (re.compile(r"\\(?!begin\b|end\b)[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{")),
    (re.compile(r"(?<![\w:\\./])\\(?!(?:begin|end)\b)[a-zA-Z]{2,}(?![\w\\./:{\[-])")),
    (re.compile(r"(?<![\\:])\\['`^\"~]\{?\\?[a-zA-Z]\}?(?![\\'\"])|\\c\{[a-zA-Z]\}")),
    (re.compile(r"(?<!\\)\\\((?!\s*\\(?![a-zA-Z])).+?\\\)|(?<!\\)\\\[(?=\s*\S).+?\\\]", re.S)),
    (re.compile(r"(?<=\w)\s?\\[&%](?=\s|\w)")),
]
_DOLLAR = re.compile(r"(?<![\\$\w])\$\$?(?![\s$])([^$\n]{1,400}?)(?<![\s\\])\$\$?(?![\w$])")
_FORMULA = re.compile(r"[\\^_={}<>+]|^[a-zA-Z](?:\(\w\)|')?$|^[a-zA-Z]\s*[-+*/]\s*\w+$")


Mark = tuple[int, int, str, str]  # begin, end, kind, token


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _sample_free(text: str) -> tuple[str, list[Mark]]:
    """The text with the insides of code samples, scripts and styles blanked, at its length, and the marks around samples.

    A mark of a sample is empty and stands before it, so that a sample is never cut.
    """
    marks: list[Mark] = []

    def keep(kind: str | None, token: str, inside: int):
        def swap(m: re.Match) -> str:
            if kind:
                marks.append((m.start(), m.start(), kind, token))
                return _blank(m.group())
            a, b = m.start(inside) - m.start(), m.end(inside) - m.start()
            return m.group()[:a] + _blank(m.group(inside)) + m.group()[b:]  # its tags are found later

        return swap

    if "```" in text or "~~~" in text:
        text = _FENCE.sub(keep("markdown", "```", 2), text)
    if "\\begin" in text:
        text = _VERBATIM.sub(keep("latex", "\\begin{verbatim}", 2), text)
    if "</" in text:
        text = _SILENT.sub(keep(None, "<script>", 3), text)
        text = _PRE.sub(keep(None, "<pre>", 3), text)
    return text, marks


#: Tags that are marks of a wiki.
_WIKI_TAGS = {"ref", "nowiki", "syntaxhighlight", "gallery", "math", "references"}
#: The kind of tags that a valid class makes html.
UNDECIDED = "html?"


def marks_of(text: str, undecided: bool = False) -> list[Mark]:
    """Every piece of markup in order of kinds, with its place in the text; code samples are looked at from outside only.

    undecided adds tags that only a template can tell from placeholders, as kind UNDECIDED.
    """
    bare, out = _sample_free(text)
    put = lambda m, kind, token: out.append((m.start(), m.end(), kind, token))
    if "<" in bare:
        if "<!--" in bare:
            for m in re.finditer(r"<!--.*?-->", bare, re.S):
                put(m, "html", "<!--")
            bare = re.sub(r"<!--.*?-->", lambda m: _blank(m.group()), bare, flags=re.S)
        for m in _TAG.finditer(bare):
            name = (m.group(2) or "!doctype").lower()
            if m.group(3) and not m.group(3).rstrip().endswith(('"', "'")) and "=" not in m.group(3).split()[-1] and not _BOOLEAN.search(m.group(3)):
                continue  # words, as of a comparison
            put(m, "wiki" if name in _WIKI_TAGS else "html", f"<{m.group(1) or ''}{name}>")
        bare = _TAG.sub(lambda m: " " * len(m.group()), bare)
        if undecided and "<" in bare:
            for m in _OPEN.finditer(bare):
                put(m, UNDECIDED, f"<{m.group(1)}{m.group(2).lower()}>")
    if "&" in bare:
        for m in _ENTITY.finditer(bare):
            if m.group()[1] == "#" or m.group()[1:] in html.entities.html5:
                put(m, "html", m.group())
    if "#" in bare:
        lines, at = bare.split("\n"), 0
        for i, line in enumerate(lines):
            if line[:1] == "#" and _HEADING.match(line):
                near = [lines[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
                sheet = i + 1 < len(lines) and "\t" in lines[i + 1]
                if not sheet and not (line[:2] == "# " and any(x[:2] == "# " for x in near)):
                    mark = line.split(" ", 1)[0]
                    out.append((at, at, "markdown", mark))
            at += len(line) + 1
    if "---" in bare or "===" in bare:
        for m in _UNDERLINED.finditer(bare):
            if "\t" not in m.group(1):
                out.append((m.start(), m.start(), "markdown", "=="))
    for mark, pattern in _MARKDOWN:
        guard = {"-|": "-|", "--|": "-|"}.get(mark, mark)
        if guard in bare or (mark == "-|" and ":|" in bare):
            out += [(m.start(), m.start(), "markdown", mark) for m in pattern.finditer(bare)]
    for mark, pattern in _WIKI:
        guard = {"[h": "[http"}.get(mark, mark)
        if guard in bare:
            out += [(m.start(), m.start(), "wiki", mark) for m in pattern.finditer(bare)]
    if "\\" in bare:
        for pattern in _LATEX:
            for m in pattern.finditer(bare):
                token = m.group().replace(" ", "") if m.group().startswith(("\\begin", "\\end")) else m.group().strip().split("[")[0].split("{")[0]
                out.append((m.start(), m.end() if token.startswith(("\\begin", "\\end")) else m.start(), "latex", token))
    if "$" in bare:
        out += [(m.start(), m.start(), "latex", "$") for m in _DOLLAR.finditer(bare) if _FORMULA.search(m.group(1)) and not re.match(r"[\d.,\s]+\w*$", m.group(1))]
    return out


def tokens_of(text: str) -> list[tuple[str, str]]:
    """(kind, token) of marks_of()."""
    return [(kind, token) for _, _, kind, token in marks_of(text)]


# ---------------------------------------------------------------- clean text

_BLOCK = re.compile(r"</?(?:p|div|ul|ol|table|tr|section|article|header|footer|nav|body|html|head|title|blockquote|dl|dt|dd|hr|form|main|aside|figure)\b[^>]*>", re.I)
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303"}


def _clean_html(t: str) -> str:
    t = re.sub(r"<!--.*?-->", "", t, flags=re.S)
    t = re.sub(r"<(script|style|noscript|svg)\b[^>]*>.*?</\1\s*>", "", t, flags=re.S | re.I)
    t = re.sub(r"<pre\b[^>]*>\s*(?:<code\b[^>]*>)?(.*?)(?:</code>)?\s*</pre>", lambda m: f"\n```\n{m.group(1).strip(chr(10))}\n```\n", t, flags=re.S | re.I)
    t = re.sub(r"<code\b[^>]*>(.*?)</code>", r"`\1`", t, flags=re.S | re.I)
    t = re.sub(r"<(title|h[1-6])\b[^>]*>(.*?)</\1\s*>", lambda m: f"\n{'#' * (int(m.group(1)[1]) if m.group(1)[1:].isdigit() else 1)} {m.group(2).strip()}\n", t, flags=re.S | re.I)
    t = re.sub(r"<li\b[^>]*>\s*", "\n- ", t, flags=re.I)
    t = re.sub(r"</t[dh]>\s*<t[dh]\b[^>]*>", " | ", t, flags=re.I)
    t = re.sub(r"<br\b[^>]*>", "\n", t, flags=re.I)
    t = _TAG.sub("", _BLOCK.sub("\n", t))
    return html.unescape(t)


def _clean_latex(t: str) -> str:
    t = _VERBATIM.sub(lambda m: f"\n```\n{m.group(2).strip(chr(10))}\n```\n", t)
    t = re.sub(r"\\documentclass(?:\[[^\]]*\])?\{[^}]*\}|\\usepackage(?:\[[^\]]*\])?\{[^}]*\}|\\maketitle|\\label\{[^}]*\}|~?\\cite\{[^}]*\}", "", t)
    t = re.sub(r"(?<!\\)%[^\n]*", "", t)
    levels = {"title": 1, "part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
    t = re.sub(r"\\(title|part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\{([^{}]*)\}", lambda m: f"\n{'#' * levels[m.group(1)]} {m.group(2)}\n", t)
    t = re.sub(r"\\begin\{(equation|align|gather|displaymath|math|eqnarray)\*?\}(.*?)\\end\{\1\*?\}", lambda m: f"\n$${m.group(2).strip()}$$\n", t, flags=re.S)
    t = re.sub(r"\\\[(.*?)\\\]", lambda m: f"$${m.group(1).strip()}$$", t, flags=re.S)
    t = re.sub(r"\\\((.*?)\\\)", lambda m: f"${m.group(1).strip()}$", t, flags=re.S)
    kept: list[str] = []
    t = re.sub(r"\$\$.*?\$\$|\$[^$\n]+\$", lambda m: kept.append(m.group()) or f"\0{len(kept) - 1}\0", t, flags=re.S)
    t = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?(?:\{[lcr|]+\})?", "", t)
    t = re.sub(r"\\item\b\s*(?:\[([^\]]*)\])?\s*", lambda m: "- " + (m.group(1) + ": " if m.group(1) else ""), t)
    t = re.sub(r"\\(['`^\"~])\{?\\?([a-zA-Z])\}?", lambda m: unicodedata.normalize("NFC", m.group(2) + _ACCENTS[m.group(1)]), t)
    t = re.sub(r"\\c\{?([a-zA-Z])\}?", lambda m: unicodedata.normalize("NFC", m.group(1) + "\u0327"), t)
    t = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", t)
    for _ in range(4):
        t, n = re.subn(r"(?<![\w:\\])\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", t)
        if not n:
            break
    t = re.sub(r"(?<![\w:\\./])\\[a-zA-Z]{2,}(?![\w\\./])\s?", "", t)
    t = re.sub(r"\\([&%#_$])", r"\1", t)
    return re.sub(r"\0(\d+)\0", lambda m: kept[int(m.group(1))], t)


def _clean_wiki(t: str) -> str:
    t = re.sub(r"^([*#:;]+)[ \t]*", lambda m: "  " * (len(m.group(1)) - 1) + ("- " if m.group(1)[-1] in "*#" else ""), t, flags=re.M)
    t = re.sub(r"^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", lambda m: f"{'#' * len(m.group(1))} {m.group(2)}", t, flags=re.M)
    t = re.sub(r"^\{\|[^\n]*\n|^\|\}[ \t]*$|^\|-[^\n]*\n", "", t, flags=re.M)
    t = re.sub(r"^[!|][ \t]*(.+)$", lambda m: re.sub(r"[ \t]*(?:!!|\|\|)[ \t]*", " | ", m.group(1)), t, flags=re.M)
    for _ in range(3):
        t = _WIKI[4][1].sub("", t)
    t = re.sub(r"\[\[:?(?:[Cc]ategory|[Cc]atégorie|[Kk]ategorie|[Cc]ategoría|[Ff]ile|[Ff]ichier|[Dd]atei|[Aa]rchivo|[Ii]mage):[^\[\]]*\]\]", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", t)
    t = re.sub(r"\[https?://[^\s\]]+[ \t]*([^\]\n]*)\]", r"\1", t)
    t = re.sub(r"'''''|'''|''", "", t)
    return t


def _clean_markdown(t: str) -> str:
    kept: list[str] = []
    t = _FENCE.sub(lambda m: kept.append(m.group()) or f"\0{len(kept) - 1}\0", t)
    t = _UNDERLINED.sub(lambda m: f"{'#' if m.group(2)[0] == '=' else '##'} {m.group(1)}", t)
    t = re.sub(r"!?\[([^\]\n]*)\]\([^)\s]+(?:\s+\"[^\"\n]*\")?\)", r"\1", t)
    t = re.sub(r"^\[\^([^\]\s]+)\]:[ \t]*", "", t, flags=re.M)
    t = re.sub(r"\[\^[^\]\s]+\]", "", t)
    t = re.sub(r"^([ \t]*[-*+])[ \t]+\[[ xX]\][ \t]", r"\1 ", t, flags=re.M)
    t = re.sub(r"^[ \t]*\|?(?:[ \t]*:?-{2,}:?[ \t]*\|)+[ \t]*(?::?-{2,}:?)?[ \t]*$\n?", "", t, flags=re.M)
    t = re.sub(r"^[ \t]*\|(.*?)\|[ \t]*$", r"\1", t, flags=re.M)
    for _, pattern in _MARKDOWN[:5]:
        for _ in range(2):
            t = pattern.sub(lambda m: m.group().strip("*_~"), t)
    return re.sub(r"\0(\d+)\0", lambda m: kept[int(m.group(1))], t)


_CLEANERS = {"html": _clean_html, "latex": _clean_latex, "wiki": _clean_wiki, "markdown": _clean_markdown}


def clean(text: str, kinds: set[str]) -> str:
    """Text without the markup of the kinds given; code blocks stay fenced and are not touched by other kinds."""
    blocks: list[str] = []
    hide = lambda t: _FENCE.sub(lambda m: blocks.append(m.group()) or f"\x01{len(blocks) - 1}\x01", t)
    for kind in ("html", "latex", "wiki", "markdown"):
        if kind in kinds:
            text = hide(_CLEANERS[kind](hide(text)))
    for _ in range(2):
        text = re.sub(r"\x01(\d+)\x01", lambda m: blocks[int(m.group(1))], text)
    return re.sub(r"\n[ \t]*(?:\n[ \t]*)+", "\n\n", re.sub(r"[ \t]+$", "", text, flags=re.M)).strip()


# ---------------------------------------------------------------- operators

_SCANNED = "id long, host string, kinds array<string>, tokens array<string>, counts array<int>, first array<int>, content string"


def scan(records: DataFrame, with_content: bool = False) -> DataFrame:
    """id, host, kinds, tokens with counts and order of first occurrence, of every record with markup or undecided tags.

    Undecided tags are tokens but give no kind, so that kinds is empty for a record of such tags only.
    records(id, content, ext, path): null and empty contents, and those of source code, have no row; ext is compared in
    lower case, a null ext is none. Repeated rows stay, null ids stay null, other columns are ignored. No shuffle.
    content is the clean text, only if asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in slices(b.column(2)):
                out: list[tuple] = []
                for i, t in enumerate(b.column(2).slice(low, high - low).to_pylist(), low):
                    found = marks_of(t, undecided=True)
                    if found:
                        seen: dict[str, list[int]] = {}
                        for begin, _, kind, token in found:
                            seen.setdefault(f"{kind} {token}", []).append(begin)
                        kinds = sorted({k for _, _, k, _ in found} - {UNDECIDED})
                        out.append((i, kinds, list(seen), [len(x) for x in seen.values()], [min(x) for x in seen.values()], clean(t, set(kinds)) if with_content else None))
                at, kinds, tokens, counts, first, text = zip(*out, strict=True) if out else ((),) * 6
                rows = pa.array(at, pa.int64())
                listed = lambda x, t: pa.array(x, pa.list_(t))
                arrays = [b.column(0).take(rows), b.column(1).take(rows), listed(kinds, pa.string()), listed(tokens, pa.string()), listed(counts, pa.int32()), listed(first, pa.int32()), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "host", "kinds", "tokens", "counts", "first", "content"])

    rows = records.where((F.length("content") > 0) & ~F.lower(F.coalesce("ext", F.lit(""))).isin(*CODE))
    host = F.split(F.coalesce("path", F.lit("")), "/")[0]
    return spread(rows.select(F.col("id").cast("long").alias("id"), host.alias("host"), "content")).mapInArrow(run, _SCANNED)


def templates(scanned: DataFrame, support: int = SUPPORT) -> DataFrame:
    """host, template, token, place, parent, records of every valid class of tokens of a host.

    Occurrence vectors are compared through sums of hashes of (record, count), which are combined before the shuffle, so
    no list of a host's records is gathered. A class is valid if it has two tokens or more, occurs in at least support
    records and its tokens stand in the same order in each; parent is the smallest valid class whose records hold those
    of the class, if there is one. Records without markup and hosts without templates give no rows. An undecided tag is
    left out unless its counterpart, the end or the beginning of its element, has the same vector.
    """
    each = scanned.select("host", "id", F.explode(F.arrays_zip("tokens", "counts", "first")).alias("x")).select("host", "id", F.col("x.tokens").alias("token"), F.col("x.counts").alias("n"), F.col("x.first").alias("at"))
    # decimal sums can't overflow
    mark = lambda salt: F.sum(F.xxhash64(F.lit(salt), "id", "n").cast("decimal(38,0)"))
    vectors = each.groupBy("host", "token").agg(mark(1).alias("v1"), mark(2).alias("v2"), F.count("*").alias("records"), F.avg("at").alias("mean_at")).where(F.col("records") >= support)
    open_tag = F.col("token").startswith(f"{UNDECIDED} ")
    element = F.when(open_tag, F.regexp_replace("token", "</?", "")).otherwise(F.col("token"))
    named = vectors.withColumn("template", F.xxhash64("host", "v1", "v2")).withColumn("element", element)
    named = named.withColumn("ends", F.count("*").over(Window.partitionBy("host", "template", "element"))).where(~open_tag | (F.col("ends") == 2)).drop("element", "ends")
    big = named.groupBy("host", "template").agg(F.count("*").alias("size")).where("size > 1").select("host", "template")
    member = named.join(big, ["host", "template"]).withColumn("place", F.row_number().over(Window.partitionBy("host", "template").orderBy("mean_at", "token")))
    in_page = each.join(member.select("host", "token", "template", "place"), ["host", "token"])
    before = F.lag("at").over(Window.partitionBy("host", "template", "id").orderBy("place"))
    broken = in_page.withColumn("before", before).where(F.col("before") > F.col("at")).select("host", "template").distinct()
    valid = member.join(broken, ["host", "template"], "left_anti")
    sizes = valid.select("host", "template", "records").distinct()
    # a class nests in another if each of its records holds the other; counted through common records
    pages = in_page.select("host", "template", "id").distinct().join(sizes, ["host", "template"])
    shared = pages.alias("i").join(pages.alias("o"), (F.col("i.host") == F.col("o.host")) & (F.col("i.id") == F.col("o.id")) & (F.col("i.template") != F.col("o.template")) & (F.col("i.records") < F.col("o.records")))
    nested = shared.groupBy(F.col("i.host").alias("host"), F.col("i.template").alias("template"), F.col("o.template").alias("parent"), F.col("i.records").alias("mine"), F.col("o.records").alias("theirs")).agg(F.count("*").alias("both")).where("both = mine")
    parent = nested.groupBy("host", "template").agg(F.min(F.struct("theirs", "parent"))["parent"].alias("parent"))
    return valid.join(parent, ["host", "template"], "left").select("host", "template", "token", "place", "parent", "records")


def kinds(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """id, markup, source of every record of scan() and kind of markup in it; an undecided tag is html where a valid class
    holds it, else nothing. source is 'template' where a valid class of
    its host has the kind in the record, 'slot' where the kind stands in the slots of its template only, and 'alone' for a
    record in no template. Repeated rows count each, a null id stays null, an empty table gives no rows. Templates are
    joined by host and token, which are few against the records."""
    each = scanned.select("id", "host", "tokens", F.monotonically_increasing_id().alias("row")).select("id", "host", "row", F.explode("tokens").alias("token"))
    classes = found.select("host", "token", F.lit(True).alias("held")).distinct()
    marked = each.join(classes, ["host", "token"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    marked = marked.where(F.col("held") | ~F.col("token").startswith(f"{UNDECIDED} "))
    kind = F.rtrim(F.substring_index("token", " ", 1), F.lit("?"))
    by_kind = marked.groupBy("row", "id", kind.alias("markup")).agg(F.max("held").alias("held"))
    any_held = F.max("held").over(Window.partitionBy("row"))
    source = F.when(F.col("held"), "template").when(any_held, "slot").otherwise("alone")
    return by_kind.withColumn("source", source).select("id", "markup", "source")


def _slots_of(text: str, template: dict[str, int], kinds: set[str]) -> list[tuple[int | None, str]]:
    """(template, clean text) of the stretches between the marks whose tokens are in valid classes, nested ones and every
    occurrence included; a stretch belongs to the class of the mark before it, the first one to that after it. Empty ones are left out."""
    cuts = sorted((begin, end, template[f"{kind} {token}"]) for begin, end, kind, token in marks_of(text, undecided=True) if f"{kind} {token}" in template)
    out, at, owner = [], 0, cuts[0][2] if cuts else None
    for begin, end, name in [*cuts, (len(text), len(text), None)]:
        if begin > at and (piece := clean(text[at:begin], kinds)):
            out.append((owner, piece))
        at, owner = max(at, end), name
    return out


def slots(records: DataFrame, scanned: DataFrame, found: DataFrame) -> DataFrame:
    """id, template, slot (from 0), content of what stands between the tokens of all valid classes of each record.

    Records of no template have no row. The classes of a record are gathered, which are at most its different tokens.
    """
    held = scanned.select("id", "host", "kinds", F.explode("tokens").alias("token")).join(found.select("host", "token", "template"), ["host", "token"])
    mine = held.groupBy("id").agg(F.first("kinds").alias("kinds"), F.collect_set(F.struct("token", "template")).alias("all"))
    joined = mine.join(records.select(F.col("id").cast("long").alias("id"), "content"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["id"], t, i, x) for r in b.to_pylist() for i, (t, x) in enumerate(_slots_of(r["content"], {c["token"]: c["template"] for c in r["all"]}, set(r["kinds"])))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((),) * 4, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["id", "template", "slot", "content"])

    return joined.select("id", "all", "kinds", "content").mapInArrow(run, "id long, template long, slot int, content string")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lexical_index.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = materialize(scan(_index(spark, sf_dir)), "scanned")
    return kinds(scanned, materialize(templates(scanned), "templates")).select("id", "markup").distinct()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_index(spark, sf_dir), with_content=True).where("size(kinds) > 0").select("id", "kinds", "content")


def p1_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates(materialize(scan(_index(spark, sf_dir)), "scanned"))


def p1_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _index(spark, sf_dir)
    scanned = materialize(scan(records), "scanned")
    return slots(records, scanned, materialize(templates(scanned), "templates"))
