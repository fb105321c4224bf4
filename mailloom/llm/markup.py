"""Clean text from HTML, Markdown, wiki and LaTeX notation, with headings, lists, code and formulas kept.

Site templates go first: the subtree of every block element of a page is hashed (tag names and text,
attributes don't count; an element's hash is made of its children's), hashes are counted per host in Spark,
and subtrees that recur on many pages of a host are deleted. Formulas and preformatted text are hashed whole, as parts of
them mean nothing by themselves. Then code blocks and formulas of any notation are set aside, so that nothing inside them
counts, and the rest is brought to one form: ``# heading``, ``- item``, fenced code, ``$formula$``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.plans.storage import written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
# Fixed values of HTML: elements without content, and block elements.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "body", "html", "div", "td", "th"}
FRAME = {"html", "body", "head", "title"}


#: Elements that can be a template; others fall with the one that holds them.
WHOLE = {"math", "pre"}


def subtrees(page: str) -> list[tuple[int, int, int]]:
    """(hash, start, end) of the block elements that hold text; frame elements are left out."""
    out: list[tuple[int, int, int]] = []
    stack: list[list] = []  # [tag, start, hash of its content so far, whether it holds text]
    at = 0

    def close(k: int, end: int) -> None:
        while len(stack) > k:
            tag, start, content, text = stack.pop()
            content.update(tag)
            sign = content.intdigest()
            if text and tag in BLOCK and tag not in FRAME and not any(x[0] in WHOLE for x in stack):
                out.append((sign - (1 << 63), start, end))
            if stack:
                stack[-1][2].update(b"\x02" + sign.to_bytes(8, "big"))
                stack[-1][3] |= text

    for m in TOKEN.finditer(page):
        text = page[at:m.start()].strip()
        if text and stack:
            stack[-1][2].update(b"\x01" + text.encode("utf-8", "surrogatepass"))
            stack[-1][3] = True
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            continue
        if tag in VOID:
            if stack:
                stack[-1][2].update(b"\x03" + tag.encode())
            continue
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k, m.end())
                    break
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES.get(tag, ()):
                    close(k, m.start())
                    break
                if stack[k][0] in SCOPES:
                    break
            stack.append([tag, m.start(), xxhash.xxh64(), False])
    text = page[at:].strip()
    if text and stack:
        stack[-1][2].update(b"\x01" + text.encode("utf-8", "surrogatepass"))
        stack[-1][3] = True
    close(0, len(page))
    return out


DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|title|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![a-zA-Z][^>]*>|<\?[^>]*\?>", re.S | re.I)
CODE_TAG = re.compile(r"<(pre|syntaxhighlight|source|listing|xmp)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
CODE_INLINE = re.compile(r"<(code|samp|kbd|tt)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
MATH_TAG = re.compile(r"<math\b[^>]*>(.*?)(?:</math\s*>|\Z)", re.S | re.I)
HEADING_TAG = re.compile(r"<h([1-6])\b[^>]*>(.*?)(?:</h\1\s*>|\Z)", re.S | re.I)
LIST_TAG = re.compile(r"<(ul|ol|dl|menu|dir)\b[^>]*>.*?<(?:li|dt|dd)\b", re.S | re.I)
ITEM_TAG = re.compile(r"<(?:li|dt|dd)\b[^>]*>", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})[^\n`]*\n(.*?)(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)", re.S | re.M)
TEX_CODE = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]]*\]|\{[^}]*\})?(.*?)(?:\\end\{\1\}|\Z)", re.S)
TEX_MATH = re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat)(\*?)\}(.*?)\\end\{\1\2\}", re.S)
TEX_DISPLAY = re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
DOLLARS = re.compile(r"(?<![\\$\w])\$\$(?!\$)([^$]+?)\$\$(?!\$)|(?<![\\$\w])\$(?![\s$])([^$\n]+?)(?<![\s\\])\$(?![\w$])", re.S)
FORMULA = re.compile(r"\\[a-zA-Z]+|[\^_]\{|\w\^|\w_\w|(?<![<>=!])=(?!=)|[+\-*/<>]")
TEX_LIST = re.compile(r"\\begin\{(itemize|enumerate|description)\}")
TEX_HEAD = re.compile(r"\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{([^{}\n]+)\}")
TEX_STYLE = re.compile(r"\\(?:textbf|textit|emph|underline|texttt|textsc|text|mbox|footnote|href\{[^{}]*\})\{([^{}]*)\}")
TEX_ITEM = re.compile(r"^[ \t]*\\item(?:\[[^\]\n]*\])?[ \t]*", re.M)
TEX_ENV = re.compile(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\])?")
WIKI_HEAD = re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\n](?:[^\n]*?[^=\n])?)[ \t]*\1[ \t]*$", re.M)
ATX = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
SETEXT = re.compile(r"^(?![ \t]*(?:[-*+>|]|\d+[.)])[ \t])[ ]{0,3}(\S[^\n]*)\n[ ]{0,3}(=+|-{2,})[ \t]*$", re.M)
ITEM = re.compile(r"^[ \t]*(?:[-+•][ \t]+|\*{1,6}[ \t]+|#{1,6}[ \t]+|[*#:;]{2,}[ \t]*(?=\w)|\d{1,9}[.)][ \t]+)(?=\S)")
WIKI_STYLE = re.compile(r"'{2,5}([^'\n]+(?:'[^'\n]+)*?)'{2,5}")
WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]")
WIKI_URL = re.compile(r"\[(?:https?|ftp)://\S+[ ]+([^\]\n]+)\]")
WIKI_TEMPLATE = re.compile(r"\{\{[^{}\n]+\}\}")
MD_LINK = re.compile(r"!?\[([^\[\]\n]+)\]\([^()\s]+(?:[ ]+\"[^\"\n]*\")?\)")
MD_STRONG = re.compile(r"(?<![\w*])(\*\*|__)(?=\S)([^*_\n]+?)(?<=\S)\1(?![\w*])")
MD_EM = re.compile(r"(?<![\w*_])([*_])(?=[^\s*_])([^*_\n]+?)(?<=[^\s*_])\1(?![\w*_])")
MD_CODE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
SPACE = re.compile(r"[ \t\u00a0]+")
GAPS = re.compile(r"\n{3,}")
HELD = re.compile("\ue000(\\d+)\ue001")


def converted(page: str | None) -> tuple[str, list[str], bool]:
    """(clean text, kinds of structure, whether the page holds mark-up of any notation)."""
    if not page:
        return "", [], False
    held: list[str] = []
    kinds: set[str] = set()

    def hold(kind: str, text: str) -> str:
        kinds.add(kind)
        held.append("```\n" + text.strip("\n") + "\n```" if kind == "code" else "$" + SPACE.sub(" ", text.replace("\n", " ")).strip() + "$")
        return f"\n\ue000{len(held) - 1}\ue001\n" if kind == "code" else f"\ue000{len(held) - 1}\ue001"

    t = page.replace("\r\n", "\n").replace("\r", "\n").replace("\ue000", " ").replace("\ue001", " ")
    marked = False
    if "<" in t:
        before = t
        t = DROP.sub("\n", t)
        t = CODE_TAG.sub(lambda m: hold("code", html.unescape(TAG.sub("", m.group(2)))), t)
        t = CODE_INLINE.sub(lambda m: hold("code", html.unescape(TAG.sub("", m.group(2)))) if "\n" in m.group(2).strip() else m.group(2), t)
        t = MATH_TAG.sub(lambda m: hold("formula", html.unescape(TAG.sub(" ", m.group(1)))), t)
        heads: list[str] = []

        def head(m: re.Match) -> str:
            inner = SPACE.sub(" ", html.unescape(TAG.sub(" ", m.group(2))).replace("\n", " ")).strip()
            if not inner:
                return "\n"
            kinds.add("heading")
            heads.append("#" * int(m.group(1)) + " " + inner)
            return f"\n\ue002{len(heads) - 1}\ue003\n"

        t = HEADING_TAG.sub(head, t)
        if LIST_TAG.search(t):
            kinds.add("list")
        t = ITEM_TAG.sub("\n\ue004", t)
        t = TAG.sub(lambda m: "\n" if m.group(2).lower() in BLOCK or m.group(2).lower() == "br" else "", t)
        marked = t != before
        t = html.unescape(t)
    else:
        heads = []
        u = html.unescape(t) if "&" in t else t
        t = u
    if "`" in t or "~~~" in t:
        t = FENCE.sub(lambda m: hold("code", m.group(2)), t)
    if "\\" in t:
        t = TEX_CODE.sub(lambda m: hold("code", m.group(2)), t)
        t = TEX_MATH.sub(lambda m: hold("formula", m.group(3)), t)
        t = TEX_DISPLAY.sub(lambda m: hold("formula", m.group(1) or m.group(2)), t)
    if "$" in t:
        t = DOLLARS.sub(lambda m: hold("formula", m.group(1) or m.group(2)) if FORMULA.search(m.group(1) or m.group(2)) and not re.match(r"\d[\d.,]*\s", m.group(1) or m.group(2)) else m.group(0), t)
    marked = marked or bool(kinds)
    if "\\" in t:
        if TEX_LIST.search(t):
            kinds.add("list")
            t = TEX_ITEM.sub("\ue004", t)
        if TEX_HEAD.search(t):
            kinds.add("heading")
            t = TEX_HEAD.sub(lambda m: "\n\ue005" + m.group(1) + "\n", t)
        u = TEX_ENV.sub("", TEX_STYLE.sub(r"\1", t))
        marked, t = marked or u != t, u
    # line notations of Markdown and wikis
    lines = t.split("\n")
    is_item = [bool(ITEM.match(x)) for x in lines]
    out: list[str] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if is_item[i]:
            j = i  # a run of items, with continuation lines and single blank lines between them
            last, n = i, 0
            while j < len(lines):
                if is_item[j]:
                    last, n = j, n + 1
                elif not lines[j].strip():
                    if j + 1 >= len(lines) or not is_item[j + 1]:
                        break
                elif not lines[j].startswith(("  ", "\t")):
                    break
                j += 1
            if n >= 2:
                kinds.add("list")
                out += ["\ue004" + ITEM.sub("", x) if it else x for x, it in zip(lines[i:last + 1], is_item[i:last + 1])]
                i = last + 1
                continue
        m = ATX.match(line) or WIKI_HEAD.match(line)
        if m:
            kinds.add("heading")
            out.append("\ue005" + m.group(2).strip())
            i += 1
            continue
        if line.strip() and i + 1 < len(lines) and SETEXT.match(line + "\n" + lines[i + 1]) and line[0] not in "\ue000\ue002\ue004\ue005":
            kinds.add("heading")
            out.append("\ue005" + line.strip())
            i += 2
            continue
        out.append(line)
        i += 1
    t = "\n".join(out)
    u = t
    for pattern, to in ((WIKI_STYLE, r"\1"), (WIKI_LINK, r"\1"), (WIKI_URL, r"\1"), (WIKI_TEMPLATE, ""), (MD_LINK, r"\1"), (MD_STRONG, r"\2"), (MD_EM, r"\2"), (MD_CODE, r"\1")):
        u = pattern.sub(to, u)
    marked = marked or u != t or bool(kinds)
    u = re.sub("\ue002(\\d+)\ue003", lambda m: heads[int(m.group(1))], u)
    u = u.replace("\ue004", "- ").replace("\ue005", "# ")
    u = "\n".join(SPACE.sub(" ", x).strip() for x in u.split("\n"))
    u = HELD.sub(lambda m: held[int(m.group(1))], GAPS.sub("\n\n", u)).strip()
    return u, sorted(kinds), marked


#: A subtree is template if it recurs on so many pages of its host, and on this share of them: copies of one mail, which
#: share what they say, are few beside all of a large host's pages.
MANY_PAGES, LEAST_SHARE = 20, 0.01
SALTS = 16


def template_subtrees(pages: DataFrame, many_pages: int = MANY_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(key, cuts): per page the spans of subtrees that are template of its host; pages: key, host, page.

    Equal pages count once. Pages of hosts without template give no row. Pages are parsed once, into a written table of
    hashes; a page's row without a subtree counts the page.
    """
    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, h, p in zip(b.key, b.host, b.page):
                sign = xxhash.xxh64_intdigest(p) - (1 << 63)
                rows += [(k, h, sign, None, 0, 0), *((k, h, sign, s, a, z) for s, a, z in subtrees(p))]
            out = pd.DataFrame(rows, columns=["key", "host", "sign", "subtree", "start", "stop"])
            out["subtree"] = out["subtree"].astype("Int64")
            yield out

    has = pages.filter(F.col("host").isNotNull() & F.col("page").contains("<"))
    trees = written(has.select("key", "host", "page").mapInPandas(hashes, "key string, host string, sign bigint, subtree bigint, start int, stop int"), "subtrees")
    counts = trees.select("host", "subtree", "sign").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= many_pages)
    counts = written(counts, "recurring")  # a subtree and a page of every 20
    sizes = counts.filter(F.col("subtree").isNull()).select("host", F.col("n").alias("pages"))
    frequent = counts.filter(F.col("subtree").isNotNull()).join(sizes, "host").filter(F.col("n") >= least_share * F.col("pages")).select("host", "subtree")
    # a template stands on all pages of what may be a third of everything: both sides are salted
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = trees.filter(F.col("subtree").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["host", "subtree", "salt"], "left_semi")
    return hit.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", (-F.col("stop")).alias("stop")))).alias("cuts"))


def without(page: str, cuts) -> str:
    """The page without the spans; spans inside others fall with them."""
    out, at = [], 0
    for c in cuts:
        a, z = c["start"], -c["stop"]  # of those that begin together the longest comes first
        if a >= at:
            out.append(page[at:a])
            at = z
    return "".join(out) + page[at:]


def clean_pages(pages: DataFrame, many_pages: int = MANY_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(key, clean, kinds, marked) for pages (key, host, page).

    Null and empty pages give an empty text without kinds. Repeated rows of a key with equal page count
    once. A null host has no template. Pages are processed whole. kinds are those of the page without its templates;
    a page that is marked up stays so if all its mark-up was template.
    """
    pages = pages.select("key", "host", "page").dropDuplicates()
    cut = pages.join(template_subtrees(pages, many_pages, least_share), "key", "left")

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p, c in zip(b.key, b.page, b.cuts):
                clean, kinds, marked = converted(without(p, c) if c is not None and p is not None else p)
                rows.append((k, clean, kinds, marked or c is not None))
            yield pd.DataFrame(rows, columns=["key", "clean", "kinds", "marked"])

    return cut.select("key", "page", "cuts").mapInPandas(convert, "key string, clean string, kinds array<string>, marked boolean")
