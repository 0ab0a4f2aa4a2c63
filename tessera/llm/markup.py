"""Problem 3: clean text of documents in HTML, Markdown, wiki or LaTeX markup, or several of them, with their structure kept.

Method: consensus paths by host (a document's repository is its host). A first pass, over the documents that hold HTML containers,
scores each container by the words in it against those of them that stand in links; the sign of a document's score is its vote on
the container's path, the tag-class steps from the root with numbers made alike, and votes are added up by repository and path in
Spark. A second pass extracts along the winning paths: an element counts if the innermost container it stands in won (navigation,
link boxes and tables of contents made of lists lose by their links) or if it stands in none. Within that a block parser
walks each document once, telling the markups apart block by block, and yields headings, list items, code blocks and formulas in
reading order, each as a reader sees it. Documents without containers go to the block parser directly.

Defined results: null, empty and blank contents yield no rows; front matter, page titles, comments, scripts, styles, tables,
boxes, figures and quotes yield none; elements without text are left out and not counted; a block that is never closed ends with
the document; white space in `plain` is collapsed, in code too; repeated rows of a document count once; equal documents under
several ids each give their rows; null repositories share one vote; extra columns are ignored; documents are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED_TAGS = frozenset("table blockquote figure script style nav aside title head select button iframe svg noscript form template caption".split())
CONTAINERS = frozenset("div section article main header footer details".split())
BLOCK_TAG = re.compile(r"\s*<(?:!doctype\b|/?(?:html|head|body|title|meta|link|p|div|section|article|main|header|footer|nav|aside|h[1-6]|ul|ol|li|dl|dt|dd|table|thead|tbody|tr|td|th|blockquote|figure|figcaption|script|style|hr|details|summary|form|center|pre)\b)", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<!doctype[^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HTML_FORMULA = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|\$\$(.+?)\$\$|<math[^>]*>(.*?)</math>", re.S)
TEXT_FORMULA = re.compile(r"<math[^>]*>(.*?)</math>|\\\((.+?)\\\)|\\\[(.+?)\\\]|(?<![\\$])\$\$(.+?)\$\$|(?<![\\$\w])\$(?![\s$])([^$`]*?[^\s\\$])\$(?![\d$])", re.S)
CODE_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
NOWIKI = re.compile(r"<nowiki>(.*?)</nowiki>", re.S)
TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
BRACES = re.compile(r"\{\{|\}\}")
REFERENCE = re.compile(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", re.S)
ANY_TAG = re.compile(r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)
FENCE = re.compile(r"([ \t]*)(`{3,}|~{3,})([^`\n]*)$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
WIKI_HEADING = re.compile(r"(={1,6})(?!=)\s*(.+?)\s*\1\s*(?:<!--.*?-->\s*)?$")
ITEM = re.compile(r"([ \t]*)([-*+]|\d{1,9}[.)])(?:[ \t]+(.*))?$")
WIKI_ITEM = re.compile(r"([*#:;]*[*#])[ \t]*(.*)$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
SOURCE = re.compile(r"\s*:*<(source|syntaxhighlight)\b[^>]*>")
DISPLAY = re.compile(r"\s*(\$\$|\\\[)")
UNDERLINE = re.compile(r" {0,3}(?:=+|-{2,}|-)[ \t]*")
WIKI_LINE = re.compile(r"[*#]{1,6}[ \t]*\S")
WIKI_NO_TEXT = re.compile(r"(?i:\[\[(?:File|Image|Category):)|__[A-Z]+__$")
LINK_DEFINITION = re.compile(r" {0,3}\[[^\]]+\]:\s*\S+")
CHECK_BOX = re.compile(r"\[[ xX]\][ \t]+")
LATEX_HEADING = re.compile(r"\s*\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\s*\{")
LATEX_BEGIN = re.compile(r"\s*\\begin\{([A-Za-z]+\*?)\}")
LATEX_CODE = frozenset("verbatim verbatim* lstlisting minted Verbatim alltt".split())
LATEX_FORMULA = frozenset("equation equation* align align* displaymath math gather gather* multline multline* eqnarray eqnarray*".split())
LATEX_LIST = frozenset("itemize enumerate description".split())
LATEX_SKIPPED = frozenset("tabular tabular* table table* figure figure* quote quotation verse tikzpicture thebibliography center comment longtable array".split())
LATEX_LINE = re.compile(r"\s*\\(?:documentclass|usepackage|maketitle|title|author|date|vspace|hspace|newpage|clearpage|pagebreak|tableofcontents|label|bibliography|bibliographystyle|noindent|centering|input|include|newcommand|begin\{document\}|end\{document\}|end\{[a-z*]+\})\b.*$|\s*\\(?:begin|end)\{document\}\s*$")
PLACE = "\ue000{}\ue001"
PLACED = re.compile("\ue000(\\d+)\ue001")


def tidy(text: str) -> str:
    return " ".join(text.split())


MARKED = re.compile(r"[`*_~\\\[<{&]|''")
ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
AUTOLINK = re.compile(r"<((?:https?://|mailto:)[^<>\s]+)>")
BREAK = re.compile(r"<br\s*/?>", re.I)
QUOTES = re.compile(r"'{2,5}")
LINKS = [  # what a reader sees of each kind of link, in the order in which they are taken apart
    (re.compile(r"\[\[(?:File|Image|Category):[^\[\]]*\]\]", re.I), ""),
    (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"!\[[^\]]*\]\((?:[^()\s]|\([^()]*\))*(?:\s+\"[^\"]*\")?\)"), ""),
    (re.compile(r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(\s*<?(?:[^()\s]|\([^()]*\))*>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)"), r"\1"),
    (re.compile(r"\[(?:https?|ftp|mailto):[^\s\]]*\s+([^\]]+)\]"), r"\1"),
    (re.compile(r"\[(?:https?|ftp)://[^\s\]]*\]"), ""),
    (re.compile(r"\[([^\[\]]+)\]\[[^\[\]]*\]"), r"\1"),
    (re.compile(r"\[\^[^\]\s]+\]"), ""),
]
EMPHASIS = [
    ("*", re.compile(r"(?<![*\\\w])(\*{1,3})(?=[^\s*])(.+?)(?<=[^\s*])\1(?![*\w])", re.S), r"\2"),
    ("**", re.compile(r"(\*\*)(?=\S)(.+?)(?<=\S)\1", re.S), r"\2"),
    ("_", re.compile(r"(?<![\w_])(_{1,3})(?=[^\s_])(.+?)(?<=[^\s_])\1(?![\w_])", re.S), r"\2"),
    ("~~", re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.S), r"\1"),
]


def braces(text: str, at: int) -> int:
    """The offset after the group whose opening brace is before `at`."""
    depth = 1
    while at < len(text) and depth:
        c = text[at]
        if c == "\\":
            at += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        at += 1
    return at


LATEX_DROPPED = re.compile(r"\\(?:label|cite[tp]?|ref|eqref|pageref|footnote|index|vspace|hspace|includegraphics)\*?(?:\[[^\]]*\])?\{")
LATEX_HREF = re.compile(r"\\href\{")
LATEX_COMMAND = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?[ ]?(?=\{)|\\(?:em|bf|it|tt|sc|sl|rm|bfseries|itshape|ttfamily|small|large)\b[ ]?")
LATEX_NAMED = {"\\textasciitilde": "~", "\\textasciicircum": "^", "\\textbackslash": "\\\ue002", "\\ldots": "…", "\\dots": "…", "\\LaTeX": "LaTeX", "\\TeX": "TeX", "\\textbar": "|", "\\textless": "<", "\\textgreater": ">", "\\S": "§"}
LATEX_NAME = re.compile("|".join(re.escape(k) + r"(?![A-Za-z])(?:\{\})?[ ]?" for k in sorted(LATEX_NAMED, key=len, reverse=True)))


def latex_plain(text: str) -> str:
    while m := LATEX_DROPPED.search(text):
        text = text[: m.start()].rstrip("~") + text[braces(text, m.end()) :]
    while m := LATEX_HREF.search(text):
        end = braces(text, m.end())
        text = text[: m.start()] + text[end:]
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return PLACE.format(len(kept) - 1)

    text = re.sub(r"(?<!\\)%.*?(?:\n|$)", " ", text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?", " ", text)
    text = re.sub(r"\\([~^\"'`])\{\}", lambda m: keep(m[1]), text)
    text = re.sub(r"\\([&%$#_{}])", lambda m: keep(m[1]), text)
    text = LATEX_NAME.sub(lambda m: keep(LATEX_NAMED[m[0].rstrip(" ").removesuffix("{}")].replace("\ue002", "")), text)
    text = LATEX_COMMAND.sub("", text)
    text = text.replace("``", "“").replace("''", "”").replace("~", " ").replace("\\ ", " ").replace("\\,", " ")
    text = text.replace("{", "").replace("}", "").replace("\\(", "").replace("\\)", "")
    return tidy(PLACED.sub(lambda m: kept[int(m[1])], text))


def html_plain(text: str) -> str:
    return tidy(html.unescape(ANY_TAG.sub("", re.sub(r"<br\s*/?>", " ", text, flags=re.I))))


def text_plain(text: str) -> str:
    """Markdown and wiki inline markup to what a reader sees."""
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return PLACE.format(len(kept) - 1)

    if not MARKED.search(text):
        return tidy(text)
    if "<nowiki>" in text:
        text = NOWIKI.sub(lambda m: keep(html.unescape(m[1])), text)
    if "`" in text:
        text = CODE_SPAN.sub(lambda m: keep(m[2].strip(" ") if m[2].strip() else m[2]), text)
    if "\\" in text:
        text = ESCAPED.sub(lambda m: keep(m[1]), text)
    if "<" in text:
        text = REFERENCE.sub("", text)
    while TEMPLATE.search(text):
        text = TEMPLATE.sub("", text)
    if "[" in text:
        for pattern, kept_part in LINKS:
            text = pattern.sub(kept_part, text)
    if "<" in text:
        text = AUTOLINK.sub(lambda m: keep(m[1]), text)
        text = ANY_TAG.sub("", BREAK.sub(" ", text))
    if "''" in text:
        text = QUOTES.sub("", text)
    for _ in range(2):
        for sign, pattern, kept_part in EMPHASIS:
            if sign in text:
                text = pattern.sub(kept_part, text)
    if "&" in text:
        text = html.unescape(text)
    for _ in range(3 if kept else 0):
        text = PLACED.sub(lambda m: kept[int(m[1])], text)
    return tidy(text)


def container_step(tag: str, attributes: str) -> str:
    """A generalised path step: the tag with its class or id, numbers made equal."""
    m = ATTRIBUTE.search(attributes)
    return tag if not m else f"{tag}.{re.sub(r'[0-9]+', '#', tidy(m[2].strip(chr(34) + chr(39))).lower())}"


class Walker:
    """One pass over a document; `rows` are (kind, plain) in reading order."""

    def __init__(self, text: str, lost: frozenset[str] = frozenset()):
        self.rows: list[tuple[str, str]] = []
        self.votes: Counter = Counter()
        self.lost = lost
        self.paragraph: list[str] = []
        self.text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
        self.lines = self.text.split("\n")
        self.offsets = [0]
        for line in self.lines:
            self.offsets.append(self.offsets[-1] + len(line) + 1)
        self.latex = "\\begin{" in self.text or "\\section" in self.text
        fenced = bool(re.search(r"^(?:```|~~~)", self.text, re.M))
        self.wiki_only = bool(re.search(r"^==.*==\s*$|'''|\[\[|<nowiki>|^\{\{", self.text, re.M)) and not fenced and not re.search(r"^#{2,6} .*\S|^[-*+] \[[ x]\]|^[-+] \S|^\d+[.)] \S|\]\((?:\.|http|/)|^---$|\*\*\S|`\S", self.text, re.M)

    def add(self, kind: str, plain: str) -> int:
        self.rows.append((kind, plain))
        return len(self.rows) - 1

    def line_at(self, offset: int) -> int:
        """The number of the first line that begins at or after an offset."""
        lo, hi = 0, len(self.lines)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.offsets[mid] < offset:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def formulas(self, text: str, pattern: re.Pattern = TEXT_FORMULA) -> None:
        if "$" not in text and "\\" not in text and "<math" not in text:
            return
        if pattern is TEXT_FORMULA:
            text = NOWIKI.sub("", CODE_SPAN.sub("", text))
        text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
        for m in pattern.finditer(text):
            source = next(g for g in m.groups() if g is not None)
            if m[0].startswith("<math") or pattern is HTML_FORMULA:
                source = html.unescape(source)
            if tidy(source):
                self.add("formula", tidy(source))

    def flush(self) -> None:
        if self.paragraph:
            self.formulas("\n".join(self.paragraph))
            self.paragraph = []

    # --- HTML ---

    def html(self, start: int) -> int:
        """Elements of the HTML that begins at an offset; the offset after it."""
        text, depth, at = self.text, 0, start
        open_: list[str] = []
        capture: list | None = None  # [kind, row, pieces]
        items: list[list] = []  # open list items: [row, pieces]
        skip = 0
        held: list[str] = []  # text of the running paragraph

        def end_text() -> None:
            nonlocal held
            if held:
                self.formulas("".join(held), HTML_FORMULA)
                held = []

        def say(piece: str) -> None:
            if not piece or hidden():
                return
            if capture is not None:
                capture[2].append(piece)
            elif items and items[-1][1] is not None:
                items[-1][1].append(piece)
            else:
                held.append(piece)

        def close_item() -> None:
            row, pieces = items.pop()
            if row is not None:
                self.rows[row] = ("list_item", html_plain("".join(pieces)))

        boxes: list[list] = []  # open containers: [path, lost, words, link words]
        links = 0

        def hidden() -> bool:
            return bool(skip or (boxes and boxes[-1][1]))

        def leave() -> None:
            path, _, words, linked = boxes.pop()
            if words:
                self.votes[path] += words - 2 * linked
            if boxes:  # what stands in a container stands in those around it
                boxes[-1][2] += words
                boxes[-1][3] += linked

        while True:
            m = TAG.search(text, at)
            stop = m.start() if m else len(text)
            if stop > at:
                piece = text[at:stop]
                if not open_ and piece.strip():
                    # plain text after the last closing tag belongs to other markup
                    cut = piece.find("\n")
                    say(piece if cut < 0 else piece[:cut])
                    at = stop if cut < 0 else at + cut
                    break
                if open_ == ["p"] and (gap := re.search(r"\n[ \t]*\n", piece)):
                    say(piece[: gap.start()])  # a paragraph that nothing closes ends at a blank line
                    at += gap.start()
                    break
                if not open_ and piece.count("\n") >= 1:
                    at = at + piece.index("\n")
                    break
                say(piece)
                if boxes:
                    words = len(piece.split())
                    boxes[-1][2] += words
                    boxes[-1][3] += words if links else 0
            if not m:
                at = len(text)
                break
            at = m.end()
            if m[2] is None:  # comment or doctype
                if not open_:
                    break
                continue
            closing, tag, attributes = m[1] == "/", m[2].lower(), m[3] or ""
            if tag in ("pre", "code") and not closing and tag == "pre" and not hidden():
                end = re.compile(r"</pre\s*>", re.I).search(text, at)
                body = text[at : end.start() if end else len(text)]
                at = end.end() if end else len(text)
                if plain := tidy(html.unescape(re.sub(r"</?(?:code|span)\b[^>]*>", "", body, flags=re.I))):
                    end_text()
                    self.add("code", plain)
                    if boxes:
                        boxes[-1][2] += len(plain.split())
                if not open_:
                    break
                continue
            if tag in ("script", "style") and not closing:
                end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
                at = end.end() if end else len(text)
                if not open_:
                    break
                continue
            if tag in ("hr", "br", "img", "meta", "link", "input") or attributes.rstrip().endswith("/"):
                say(" " if tag == "br" else "")
                if not open_:
                    break
                continue
            if tag == "math" and not closing:
                end = text.find("</math>", at)
                say(text[m.start() : end + 7 if end >= 0 else len(text)])
                at = end + 7 if end >= 0 else len(text)
                continue
            if tag == "a":
                links = 0 if closing else 1
            if closing:
                if tag in ("ul", "ol"):
                    if not hidden() and items and items[-1][0] is not None and items[-1][2] == depth:
                        row = items.pop()
                        self.rows[row[0]] = ("list_item", html_plain("".join(row[1])))
                    depth = max(0, depth - 1)
                if tag == "li" and not hidden() and items and items[-1][2] == depth:
                    row = items.pop()
                    self.rows[row[0]] = ("list_item", html_plain("".join(row[1])))
                if capture is not None and tag == capture[0]:
                    plain = html_plain("".join(capture[2]))
                    self.rows[capture[1]] = ("heading", plain)
                    capture = None
                if tag in open_:
                    while open_:
                        gone = open_.pop()
                        if gone.startswith("-"):
                            skip -= 1
                        if gone in CONTAINERS and boxes:
                            leave()
                        if gone.lstrip("-") == tag:
                            break
                elif f"-{tag}" in open_:
                    while open_:
                        gone = open_.pop()
                        if gone.startswith("-"):
                            skip -= 1
                        if gone in CONTAINERS and boxes:
                            leave()
                        if gone == f"-{tag}":
                            break
                if tag in ("p", "div", "li", "ul", "ol", "blockquote", "table") and capture is None:
                    end_text()
                if not open_:
                    break
                continue
            # opening tags
            if re.fullmatch(r"h[1-6]", tag):
                end_text()
                if not hidden():
                    capture = [tag, self.add("heading", ""), []]
                open_.append(tag)
            elif tag in ("ul", "ol"):
                end_text()
                depth += 1
                open_.append(tag)
            elif tag == "li":
                if not hidden():
                    if items and items[-1][2] == depth:
                        row = items.pop()
                        self.rows[row[0]] = ("list_item", html_plain("".join(row[1])))
                    items.append([self.add("list_item", ""), [], depth])
                if depth == 0:
                    open_.append(tag)
            elif tag in SKIPPED_TAGS:
                end_text()
                skip += 1
                open_.append(f"-{tag}")
            elif tag in CONTAINERS:
                end_text()
                path = (boxes[-1][0] + "/" if boxes else "") + container_step(tag, attributes)
                boxes.append([path, path in self.lost, 0, 0])
                open_.append(tag)
            elif tag in ("p", "html", "body", "dl", "dt", "dd", "center", "summary", "figcaption"):
                end_text()
                if tag == "p" and "p" in open_:
                    while open_.pop() != "p":
                        pass
                open_.append(tag)
            else:
                say(m[0])
                if not open_:
                    open_.append(tag)
        end_text()
        while items:
            row = items.pop()
            self.rows[row[0]] = ("list_item", html_plain("".join(row[1])))
        if capture is not None:
            self.rows[capture[1]] = ("heading", html_plain("".join(capture[2])))
        while boxes:
            leave()
        return max(at, start + 1)

    # --- LaTeX lists ---

    def latex_list(self, i: int) -> int:
        """The list that begins at line i; the line after it."""
        depth, open_ = 0, []  # open items: [row, pieces, depth]

        def close(level: int) -> None:
            while open_ and open_[-1][2] >= level:
                row, pieces, _ = open_.pop()
                self.rows[row] = ("list_item", latex_plain(" ".join(pieces)))

        while i < len(self.lines):
            line = self.lines[i].strip()
            i += 1
            if m := re.match(r"\\begin\{(\w+\*?)\}", line):
                if m[1] in LATEX_LIST:
                    depth += 1
                    continue
            if m := re.match(r"\\end\{(\w+\*?)\}", line):
                if m[1] in LATEX_LIST:
                    close(depth)
                    depth -= 1
                    if not depth:
                        return i
                    continue
            if line.startswith("%"):
                continue
            if m := re.match(r"\\item(?:\[([^\]]*)\])?(?![A-Za-z])\s*(.*)", line):
                close(depth)
                open_.append([self.add("list_item", ""), [((m[1] + " ") if m[1] else "") + m[2]], depth])
            elif line and open_ and open_[-1][2] == depth:
                open_[-1][1].append(line)
        close(0)
        return i

    # --- lists of lines ---

    def line_list(self, i: int, wiki: bool) -> int:
        """The list that begins at line i, in Markdown or wiki notation; the line after it."""
        pieces: list[str] = []
        row = -1
        indent = 0

        def close() -> None:
            if row >= 0:
                body = " ".join(pieces)
                self.rows[row] = ("list_item", text_plain(CHECK_BOX.sub("", body, count=1) if CHECK_BOX.match(body) else body))

        while i < len(self.lines):
            line = self.lines[i]
            if wiki and (m := WIKI_ITEM.match(line)):
                close()
                row, pieces = self.add("list_item", ""), [m[2]]
                i += 1
                continue
            m = None if wiki or RULE.match(line) else ITEM.match(line)
            if m:
                close()
                row, pieces, indent = self.add("list_item", ""), [m[3] or ""], len(m[1].expandtabs(4)) + len(m[2]) + 1
                i += 1
                continue
            if not line.strip():
                nxt = self.lines[i + 1] if i + 1 < len(self.lines) else ""
                if not wiki and nxt.strip() and ((ITEM.match(nxt) and not RULE.match(nxt) and len(nxt) - len(nxt.lstrip()) >= 0 and ITEM.match(nxt)[2][-1] == self.marker(i)) or (len(nxt) - len(nxt.lstrip()) >= max(2, indent) and not ITEM.match(nxt))):
                    if not ITEM.match(nxt):  # a further paragraph or block of the item
                        if FENCE.match(nxt):
                            close()
                            i = self.fence(i + 1)
                            row = -1
                            continue
                        i += 1
                        continue
                    i += 1
                    continue
                break
            if wiki or self.interrupts(line):
                if not wiki and (f := FENCE.match(line)) and len(f[1]) >= 2:
                    close()
                    row = -1
                    i = self.fence(i)
                    continue
                break
            pieces.append(line.strip())
            i += 1
        close()
        return i

    def marker(self, i: int) -> str:
        """The last character of the marker of the item before line i."""
        while i >= 0:
            if m := ITEM.match(self.lines[i]):
                return m[2][-1]
            i -= 1
        return ""

    def interrupts(self, line: str) -> bool:
        return bool(FENCE.match(line) or ATX.match(line) or WIKI_HEADING.match(line) or RULE.match(line) or line.lstrip().startswith((">", "<!--", "{{", "{|", "$$", "\\[")) or BLOCK_TAG.match(line) or LATEX_BEGIN.match(line) or LATEX_HEADING.match(line) or re.match(r"\s*<(?:source|syntaxhighlight|math)\b", line))

    def fence(self, i: int) -> int:
        m = FENCE.match(self.lines[i])
        mark, body = m[2], []
        i += 1
        while i < len(self.lines):
            line = self.lines[i]
            i += 1
            bare = line.strip()
            if bare and bare[0] == mark[0] and len(bare) >= len(mark) and not bare.strip(mark[0]):
                break
            body.append(line)
        if plain := tidy("\n".join(body)):
            self.add("code", plain)
        return i

    # --- blocks ---

    def walk(self) -> Walker:
        lines, i = self.lines, 0
        while i < len(lines) and not lines[i].strip():
            i += 1
        if i < len(lines) and lines[i].rstrip() in ("---", "+++"):
            mark = lines[i].rstrip()
            for j in range(i + 1, len(lines)):
                if lines[j].rstrip() in (mark, "..."):
                    i = j + 1
                    break
        while i < len(lines):
            line = lines[i]
            bare = line.strip()
            if not bare:
                self.flush()
                i += 1
            elif bare.startswith("<!--"):
                self.flush()
                end = self.text.find("-->", self.offsets[i])
                i = len(lines) if end < 0 else self.rest(end + 3)
            elif FENCE.match(line):
                self.flush()
                i = self.fence(i)
            elif bare.startswith(">"):
                self.flush()
                while i < len(lines) and lines[i].strip() and (lines[i].lstrip().startswith(">") or not self.interrupts(lines[i])):
                    i += 1
            elif m := SOURCE.match(line):
                self.flush()
                begin = self.offsets[i] + m.end()
                end = self.text.find(f"</{m[1]}>", begin)
                if plain := tidy(self.text[begin : end if end >= 0 else len(self.text)]):
                    self.add("code", plain)
                i = len(lines) if end < 0 else self.rest(end + len(m[1]) + 3)
            elif BLOCK_TAG.match(line):
                self.flush()
                i = self.rest(self.html(self.offsets[i] + len(line) - len(line.lstrip())))
            elif m := DISPLAY.match(line):
                self.flush()
                close = "$$" if m[1] == "$$" else "\\]"
                begin = self.offsets[i] + m.end()
                end = self.text.find(close, begin)
                if end < 0:
                    i += 1
                    continue
                if plain := tidy(re.sub(r"\\label\{[^}]*\}", "", self.text[begin:end])):
                    self.add("formula", plain)
                i = self.rest(end + len(close))
            elif bare.startswith("{|"):
                self.flush()
                while i < len(lines) and not lines[i].strip().startswith("|}"):
                    i += 1
                i += 1
            elif bare.startswith("{{") and not self.paragraph:
                depth = at = 0
                for m in BRACES.finditer(self.text, self.offsets[i]):
                    depth += 1 if m[0] == "{{" else -1
                    at = m.end()
                    if not depth:
                        break
                i = self.rest(at) if not depth else i + 1
            elif m := LATEX_BEGIN.match(line):
                self.flush()
                name = m[1]
                if name in LATEX_LIST:
                    i = self.latex_list(i)
                elif name in LATEX_CODE or name in LATEX_FORMULA or name in LATEX_SKIPPED:
                    begin = self.offsets[i] + m.end()
                    end = self.text.find(f"\\end{{{name}}}", begin)
                    body = self.text[begin : end if end >= 0 else len(self.text)]
                    if name in LATEX_CODE:
                        body = re.sub(r"\A(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?[ \t]*\n", "", body)
                        if plain := tidy(body):
                            self.add("code", plain)
                    elif name in LATEX_FORMULA and (plain := tidy(re.sub(r"\\label\{[^}]*\}|\\nonumber", "", body))):
                        self.add("formula", plain)
                    i = len(lines) if end < 0 else self.rest(end + len(name) + 6)
                else:
                    i += 1
            elif m := LATEX_HEADING.match(line):
                self.flush()
                begin = self.offsets[i] + m.end()
                end = braces(self.text, begin)
                if plain := latex_plain(self.text[begin : end - 1]):
                    self.add("heading", plain)
                i = self.rest_of_line(end)
            elif LATEX_LINE.match(line) or (self.latex and bare.startswith("%")):
                self.flush()
                i += 1
            elif (m := WIKI_HEADING.match(line)) and not self.paragraph:
                if plain := text_plain(m[2]):
                    self.add("heading", plain)
                i += 1
            elif (m := ATX.match(line)) and not self.wiki_numbered(i):
                self.flush()
                body = re.sub(r"(?:^|[ \t]+)#+$", "", m[2] or "")
                body = re.sub(r"[ \t]*\{[#.:][^{}]*\}$", "", re.sub(r"(?:^|[ \t]+)#+$", "", body))
                if plain := text_plain(body):
                    self.add("heading", plain)
                i += 1
            elif self.paragraph and UNDERLINE.fullmatch(line) and not (bare == "-"):
                body = "\n".join(self.paragraph)
                self.paragraph = []
                body = re.sub(r"[ \t]*\{[#.:][^{}]*\}$", "", body)
                if plain := text_plain(body):
                    self.add("heading", plain)
                i += 1
            elif RULE.match(line) or (bare[:4] == "----" and not bare.strip("-")):
                self.flush()
                i += 1
            elif line[:1] in "*#" and WIKI_LINE.match(line) and self.wiki_numbered(i):
                self.flush()
                i = self.line_list(i, wiki=True)
            elif (m := ITEM.match(line)) and not (self.paragraph and m[2][-1] in ".)" and m[2] not in ("1.", "1)")):
                self.flush()
                i = self.line_list(i, wiki=False)
            elif LINK_DEFINITION.match(line) and not self.paragraph:
                i += 1
            elif "|" in line and i + 1 < len(lines) and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*", lines[i + 1]) and "|" in lines[i + 1]:
                self.flush()
                while i < len(lines) and lines[i].strip() and "|" in lines[i]:
                    i += 1
            elif bare[0] in "[_" and WIKI_NO_TEXT.match(bare):
                i += 1
            else:
                self.paragraph.append(line)
                i += 1
        self.flush()
        return self

    def wiki_numbered(self, i: int) -> bool:
        """Whether the line is a wiki list line: `#` next to another such line or with wiki markup in it, or `**`; a lone `#` is a heading."""
        line = self.lines[i]
        if not re.match(r"[*#:;]*[*#][ \t]*\S", line):
            return False
        if line[0] == "*":
            if re.match(r"\*[*#]+ ", line):
                return True
            j = i + 1
            while j < len(self.lines) and self.lines[j][:1] in "*#" and self.lines[j].strip():
                if re.match(r"\*[*#]+ ", self.lines[j]):
                    return True
                j += 1
            return (self.wiki_only and line[1:2] == " ") or bool(re.match(r"\* .*(?:'''|\[\[|<nowiki>|\[https?:)", line))
        if not re.match(r"#+[*#:]* ", line):
            return False
        near = [self.lines[j] for j in (i - 1, i + 1) if 0 <= j < len(self.lines)]
        return any(re.match(r"#+[*#:]* \S", x) for x in near) or bool(re.search(r"'''|''\w|\[\[|<nowiki>|\[https?:\S+ ", CODE_SPAN.sub("", line)))

    def rest(self, offset: int) -> int:
        """The next line to look at after an offset; what is left of the offset's own line is put in front of it."""
        n = self.line_at(offset)
        if n and self.offsets[n] > offset:
            tail = self.text[offset : self.offsets[n] - 1]
            if tail.strip():
                self.lines[n - 1] = tail.strip()
                self.offsets[n - 1] = offset + len(tail) - len(tail.lstrip())
                return n - 1
        return n

    def rest_of_line(self, offset: int) -> int:
        """The line after the one an offset stands in: labels behind a heading are no text."""
        n = self.line_at(offset)
        tail = self.text[offset : self.offsets[n] - 1] if n and self.offsets[n] > offset else ""
        return self.rest(offset) if re.sub(r"\\label\{[^}]*\}", "", tail).strip() else n


def elements(text: str | None, lost: frozenset[str] = frozenset()) -> list[tuple[str, int, str]]:
    """(kind, seq, plain) of a document."""
    if not text or not text.strip():
        return []
    seq: Counter = Counter()
    out = []
    for kind, plain in Walker(text, lost).walk().rows:
        if plain:
            seq[kind] += 1
            out.append((kind, seq[kind], plain))
    return out


HAS_CONTAINER = "(?i)<(" + "|".join(sorted(CONTAINERS)) + r")\b"


def path_votes(documents: DataFrame) -> DataFrame:
    """(md_id, repo, path, vote): 1 or -1 for each container path of each document that has containers."""
    id_type = documents.schema["md_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, path, 1 if score >= 0 else -1) for k, text in enumerate(batch.column(2).to_pylist()) for path, score in Walker(text).walk().votes.items()]
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["md_id", "repo", "path", "vote"])

    return documents.where(F.col("content").rlike(HAS_CONTAINER)).select("md_id", "repo", "content").mapInArrow(run, f"md_id {id_type}, repo string, path string, vote long")


def losing_paths(votes: DataFrame) -> DataFrame:
    """(repo, path): container paths that more of a repository's documents fill with links than with text."""
    return votes.groupBy("repo", "path").agg(F.sum("vote").alias("score")).where("score < 0").select("repo", "path")


def extract_elements(documents: DataFrame, max_paths: int = 200_000) -> DataFrame:
    """(md_id, kind, seq, plain), rows of each document once. Lost paths reach the second pass by broadcast if they are few, else as
    the set of each document that has some, joined on its id."""
    id_type = documents.schema["md_id"].dataType.simpleString()
    votes = path_votes(documents)
    rows = losing_paths(votes).limit(max_paths + 1).collect()
    names = ["md_id", "kind", "seq", "plain"]
    source = documents.select("md_id", "repo", "content")
    if len(rows) <= max_paths:
        table: dict = defaultdict(set)
        for r in rows:
            table[r["repo"]].add(r["path"])
        held = documents.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in table.items()})
        source = source.withColumn("lost", F.lit(None).cast("array<string>"))
    else:
        held = None
        gone = losing_paths(votes).select(F.col("repo").alias("_repo"), F.col("path").alias("_path"))
        own = votes.join(gone, F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("path") == F.col("_path")), "left_semi").groupBy(F.col("md_id").alias("_md")).agg(F.collect_set("path").alias("lost"))
        source = source.join(own, source["md_id"].eqNullSafe(own["_md"]), "left").select("md_id", "repo", "content", "lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value if held is not None else {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: list[list] = [[] for _ in names]
                for md_id, repo, text, own in zip(*(c.to_pylist() for c in part.columns)):
                    for kind, seq, plain in elements(text, frozenset(own or table.get(repo, ()))):
                        for column, value in zip(out, (md_id, kind, seq, plain)):
                            column.append(value)
                kinds = [part.schema.field(0).type, pa.string(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    found = source.mapInArrow(run, f"md_id {id_type}, kind string, seq int, plain string")
    return found.dropDuplicates(["md_id", "kind", "seq"])
