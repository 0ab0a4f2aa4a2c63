"""Statements of nine languages over classes of tokens, reduced with a stack.

The lexer hands over code without comments and with blank literals. Every token becomes one letter, its class; brackets are
reduced from the inside out: the content of a group is checked in the context of what stands before it, and the group becomes
one letter of its own (P parentheses, Q brackets, B braces). What is left of a file is the row of its top-level statements.
Two tables say what a language holds: neighbours that no statement of it can have, and the forms of its top-level statements.

Classes shared by the languages: a name, n number, s string, t raw or template string, o binary operator, = assignment,
c increment, R =>, A ->, D ::, W :=, e ellipsis, z a sign the language hasn't; other letters stand for the language's own words.
"""

from __future__ import annotations

import re
from collections.abc import Callable

TOKEN = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|(?<![\w)\]])\.\d\w*|\"\"|``|\n|\.\.\.|=>|->|::|:=|===|!==|\*\*=|>>=|<<=|//=|\?\?=|&&=|\|\|=|[-+*/%&|^@]=(?!=)|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\*\*|\+\+|--|[^\s\w]")
OPERATORS = {
    "=>": "R", "->": "A", "::": "D", ":=": "W", "...": "e", "\"\"": "s", "``": "t", "++": "c", "--": "c", "?.": ".",
    "===": "o", "!==": "o", "==": "o", "!=": "o", "<=": "o", ">=": "o", "&&": "o", "||": "o", "??": "o", "**": "o",
    "**=": "=", ">>=": "=", "<<=": "=", "//=": "=", "??=": "=", "&&=": "=", "||=": "=", "+=": "=", "-=": "=", "*=": "=", "/=": "=", "%=": "=", "&=": "=", "|=": "=", "^=": "=", "@=": "=",
}
PLAIN = "\n()[]{},;:.=<>+-*/%&|^~!?@#"


def table(words: dict[str, str], missing: str = "", base: dict[str, str] | None = None) -> dict[str, str]:
    """Class of each token: `words` gives the words of each class; signs in `missing` (by a blank) are none of the language."""
    found = dict(base or {}) or {**OPERATORS, **{c: c for c in PLAIN}}
    for kind, listed in words.items():
        found.update(dict.fromkeys(listed.split(), kind))
    found.update(dict.fromkeys(missing.split(), "z"))
    return found


JS_WORDS = {
    "k": "typeof void delete await new yield return throw case default break continue",
    "w": "if while for switch catch with", "y": "try finally do else", "o": "in instanceof", "m": "of as from extends async get set static satisfies accessor target",
    "v": "let var", "V": "const", "f": "function", "l": "class", "i": "import", "x": "export",
}
JS = table(JS_WORDS, "-> :: :=")
TS = table(
    {
        "k": "keyof infer asserts unique", "m": "is implements public private protected readonly override abstract out", "I": "interface", "T": "type", "E": "enum", "N": "namespace module declare",
    },
    "",
    JS,
)
CLASSES = {
    "javascript": JS, "typescript": TS, "tsx": TS,
    "java": table(
        {
            "m": "public private protected static final abstract synchronized native transient volatile strictfp default sealed extends implements throws permits super",
            "k": "return throw case new yield assert instanceof break continue goto else do try finally", "w": "if while for switch catch", "l": "class", "I": "interface", "E": "enum", "p": "package", "i": "import",
        },
        ":= => # === !== ** ?? ?. $ **= ??=",
    ),
    "c": table(
        {
            "m": "static inline const volatile unsigned signed long short int char float double void register auto restrict __inline __inline__ __restrict _Noreturn _Bool __extension__ __attribute__ _Alignas _Thread_local",
            "k": "return case default goto break continue else do sizeof", "w": "if while for switch", "l": "struct union enum", "T": "typedef", "x": "extern", "S": "asm __asm__ __asm",
        },
        ":= => :: @ $ === !== ?? ?. **= ??=",
    ),
    "go": table(
        {
            "k": "return case default goto break continue else defer go range fallthrough select interface struct map chan", "w": "if for switch", "f": "func", "v": "var", "V": "const", "T": "type", "p": "package", "i": "import",
        },
        "=> -> :: ? @ # $ === !== ?? ?. \\",
    ),
    "rust": table(
        {
            "k": "return break continue else in as mut ref move dyn where unsafe async await box match if while loop for let impl", "m": "pub extern unsafe async default crate", "f": "fn", "l": "struct enum union trait mod impl", "u": "use", "V": "const static type", "M": "macro_rules",
        },
        ":= === !== ?? ?.",
    ),
    "python": table(
        {
            "o": "and or in is", "!": "not", "k": "lambda", "w": "if elif while with for", "y": "else try finally", "x": "except", "l": "class", "f": "def", "i": "import", "F": "from", "g": "as",
            "r": "return del assert raise yield global nonlocal", "b": "pass break continue", "j": "async", "h": "await",
        },
        "=== !== ?? ?. && || => $ ? \\",
    ),
    "ruby": table(
        {
            "o": "and or", "!": "not", "w": "if unless while until for case when elsif in", "y": "else then do begin ensure rescue", "d": "end", "l": "class module", "f": "def", "k": "return yield super break next puts",
        },
        ":= ++ --",
    ),
}
CLASSES["go"].update({"<-": "L", "**": "*"})
CLASSES["c"].update({"**": "*"})
CLASSES["python"].update({"**": "*", "->": "A", ":=": "W", "!": "z", "++": "+", "--": "-", "::": ":"})
CLASSES["rust"].update({"**": "*", "??": "?", "++": "z", "--": "z"})


def classes_of(code: str, language: str, lines: bool) -> str:
    """The classes of all tokens; without line ends where they mean nothing."""
    get = CLASSES[language].get
    return "".join([get(t) or ("n" if t[0] in "0123456789." else "a" if t[0] == "_" or t[0].isalpha() or t[0] == "$" else "z") for t in TOKEN.findall(code) if lines or t != "\n"])


GROUP = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}")


class Wrong(Exception):
    """A statement that the language hasn't."""


def reduce_groups(text: str, check: Callable[[str, str, str], str | None]) -> str:
    """Brackets from the inside out; check(opening, content, what stands before) may give the group's letter."""

    def one(m: re.Match) -> str:
        start = m.start()
        opening = m.string[start]
        content = m[1] if opening == "(" else m[2] if opening == "[" else m[3]
        return check(opening, content, m.string[max(0, start - 40) : start]) or {"(": "P", "[": "Q", "{": "B"}[opening]

    while True:
        reduced = GROUP.sub(one, text)
        if reduced == text:
            return text
        text = reduced


# --- scripts -------------------------------------------------------------------------------------------------------------

NAME = "[amTNkIE]"
SCRIPT_KEY = re.compile(r"(?<=\.)[a-zA-Z]|(?<=\.#)[a-zA-Z]|[kwyvVflixITENom](?=\??:(?!:))(?<=[,{;(]\w)|(?<=[,{;(]\n)[kwyvVflixITENom](?=\??:)|(?<=[,{;(]\n)[kwvVflixITENomy](?=[,}]|\n})|(?<=[,{])[kwvVflixITENomy](?=[,}])|[kwflixITENvVom](?=:(?=[^\n]))(?<!k)")
SCRIPT_WRONG = re.compile(
    r"[an][ans]|[ts][ants]|n\(|[\]][ans]"  # two operands side by side on a line
    r"|(?<!m)w(?!\n*[({k#])|y(?=\n*[:|)\],=.])|z|W|D|A"
    rf"|(?<![\w.#@])i(?![(.s]|T?(?:{NAME}(?:,\n*(?:\{{[^{{}}]*\}}|\*\n*m{NAME}))?|\{{[^{{}}]*\}}|\*\n*m{NAME})\n*ms|T?{NAME}=)"
    r"|(?<![.#@])x(?:[ans(\[]|\n*\Z)"
    rf"|l(?!{NAME}(?=\n*[{{<m])|[{{m])"
    rf"|(?<!\n)\n*I{NAME}(?!\n*[{{<m,:;=()|&.>?}}\])])|E{NAME}(?!\n*[{{,:;=()|&.>?}}\])])"
    rf"|(?:^|(?<=[\n;]))(?:x|N|xN)?Ta(?!\n*[=<,}}m:.(;?)\[])(?!\n)|(?:^|(?<=[\n;]))(?:x|N|xN)?Na(?!\n*[{{.:=,(;?)m\[])"
    rf"|[vV](?!\n*[aTmNkIEwoyif\[{{.,)=;:?])|v{NAME}(?!\n*[=:,;!)mo}}]|\n|\Z)|V[aTmNkI](?!\n*[=:,;!)mo}}]|\n|\Z)|V[aTmNkI]\n*\Z"
    rf"|f(?!\*?\n*[a-zA-Z]?\n*[(<])|@(?![a-zA-Z(])"
    r"|[=o+\-&^R/](?=\n*[)\]};,])|[=o][=*%,)\]]|[=o+\-&|^R.,<?:@!*/]\n*\Z|%(?=\n*[)\]}; ,=])|\?\n*\Z"
    r"|^\n*\{\n*s\n*:|(?:^|\n)#(?![a-zA-Z])|R(?=\n*[=o.])"
)
JS_ONLY_WRONG = re.compile(rf"[vV]{NAME}:|\?:|\?[),]|[\w)\]]!\.|[a-z)\]]!\[|f\*?[a-zA-Z]?<|>\(\)(?!R)|\?\.<|[aP]!(?=[;),\n])")


def script(code: str, language: str) -> None:
    text = classes_of(code, language, True)
    text = re.sub(r"\n+", "\n", text)
    text = SCRIPT_KEY.sub("a", text)
    if m := SCRIPT_WRONG.search(text):
        raise Wrong(m.start())
    plain = language == "javascript"
    if plain and (m := JS_ONLY_WRONG.search(text)):
        raise Wrong(m.start())

    def check(opening: str, content: str, before: str) -> str | None:
        if plain:
            if opening == "(" and ":" in content and "?" not in content:
                raise Wrong(0)
            if opening == "{" and re.search(r"l(?:[am.PQ<>,]|\n)*$", before) and re.search(r"(?:^|[;\n}B])[am#]+:", content):
                raise Wrong(0)
        if opening == "{" and re.search(r"[wf][a-zA-Z]?\n*P\n*$", before) and re.search(r"^\n*(?:a|s):[ans],", content):
            raise Wrong(0)
        return None

    left = reduce_groups(text, check)
    if re.search(r"(?:^|[\n;B])(?:xk?|m|xm)?f\*?[a-zA-Z]?P(?::[^\n;{}B]*)?\n*\Z", left) and plain:
        raise Wrong(len(left))
    if re.search(r"(?:^|[\n;B])(?:x|N|xm|m)*(?:l[a-zA-Z]?|I[a-zA-Z]|E[a-zA-Z])(?:[am.,<>PQ|&]|\n)*\Z|(?:^|[\n;B])(?:x|N)*T[a-zA-Z]\n*\Z|[\n;B]wP\n*\Z|[\n;B]y\n*\Z|(?:^|[\n;])iB\n*\Z|(?:^|[\n;B])(?:x[mk]*|m)?f\*?[a-zA-Z]?P(?::[^\n;{}B]*)?\n*\Z|@[a-zA-Z.]*P?\n*\Z", left):
        raise Wrong(len(left))
    if plain and re.search(r"(?<![k?\w])P:(?!\n)[^\n?]*B", left) and not re.search(r"\?[^\n]*P:|\n\?|\?\n", left):
        raise Wrong(0)


# --- Python --------------------------------------------------------------------------------------------------------------

PY_WRONG = re.compile(
    r"a[anstB]|n[anstPB]|[st][anPB](?<!sP)|P[anstB]|Q[anstB]|B[anstB]|z|"
    r"[=o+\-*/%&|^<>.,:!~WA@](?=[o=/%&|^<>.])(?<!\*(?=\*))(?<!!(?=o))(?<!,(?=[.=]))(?<!:(?=\.))(?<!=(?=\.))(?<!,(?=/))|k(?![^,]*:|[^:]*:)|(?<![,=(:\[])(?<!^)[o=+\-/%&|^<>.!~WA@]\Z|[kwyxlfiFjrh][o/%|^<>]|g(?![aPQ])"
)
PY_HEAD = {"f": re.compile(r"fa(?:Q)?P(?:A.+)?:"), "l": re.compile(r"laQ?P?:"), "w": re.compile(r"w.+:"), "y": re.compile(r"y:"), "x": re.compile(r"x\*?[^:]*:"), "j": re.compile(r"j(?:fa(?:Q)?P(?:A.+)?:|w.+:)")}
PY_SIMPLE = {
    "i": re.compile(r"ia(?:\.a)*(?:ga)?(?:,a(?:\.a)*(?:ga)?)*\Z"),
    "F": re.compile(r"F(?:D?a(?:\.a)*|D)i(?:P|\*|a(?:ga)?(?:,a(?:ga)?)*)\Z"),
    "b": re.compile(r"b\Z"),
}
PY_EMPTY_ENDS = frozenset(":=o+-/%&|^<>.!~WAgkh@")


def python_line(line: str) -> bool:
    """Whether a simple statement's classes are one."""
    if not line:
        return False
    first = line[0]
    if first in PY_SIMPLE:
        return bool(PY_SIMPLE[first].match(line))
    if first in "wyxlfj":
        return False
    if line[-1] in PY_EMPTY_ENDS or (line[-1] == "*"):
        return False
    if first == "@":
        return len(line) > 1
    if line == "!" or (first in "o/%|^<>=.,:") or line in ("k", "w"):
        return False
    body = line
    if first == "r":
        body = line[1:]
        if body.startswith("F") or not body:
            return True
    if body.count("w") or "y" in body:  # conditional expressions: each `if` has its else; comprehensions stand in groups
        if not re.fullmatch(r"[^wy]*(?:w[^wy]+y[^wy]+|k[^wy]*)*", body):
            return False
    return not re.search(r"[lfijxbr]", body.replace("rF", "").replace("r", "", 1) if "=r" in body or "=Wr" in body else body)


def python(code: str) -> str | None:
    """The kind of failure of code whose brackets are balanced, or None."""
    code = re.sub(r"\\\n", " ", code)
    width: list[int] = []
    tokens = re.sub(r"(?<=F)[.e]+", "D", classes_of(code, "python", True))
    tokens = re.sub(r"(?<=\.)[a-zA-Z!]", "a", tokens).replace("//", "/").replace("<<", "+").replace(">>", "+")

    def check(opening: str, content: str, before: str) -> str | None:
        if "\n" in content:
            content = content.replace("\n", "")
        if m := PY_WRONG.search(content):
            raise Wrong(m.start())
        if re.search(r"[ifFlbxr](?!F)", content) and not re.fullmatch(r"r[^ifFlbx]*", content):
            raise Wrong(0)
        if opening == "(" and ";" in content or content[:1] in (",",) or ",," in content:
            raise Wrong(0)
        return None

    try:
        # line by line: a group may span lines, so it is reduced first, and its lines are joined
        flat = reduce_groups(tokens, check)
    except Wrong:
        return "foreign construct"
    # indentation of logical lines
    depth, fresh = 0, True
    for raw in code.split("\n"):
        if not raw.strip():
            continue
        if depth <= 0:
            stripped = raw.expandtabs(8)
            width.append(len(stripped) - len(stripped.lstrip()))
            depth = 0
        depth += raw.count("(") + raw.count("[") + raw.count("{") - raw.count(")") - raw.count("]") - raw.count("}")
    lines = [x for x in flat.split("\n") if x]
    if len(lines) != len(width):
        return "foreign construct"
    levels, expect = [0], False
    for indent, line in zip(width, lines):
        if expect:
            if indent <= levels[-1]:
                return "premature end"
            levels.append(indent)
        elif indent > levels[-1]:
            return "foreign construct"
        else:
            while indent < levels[-1]:
                levels.pop()
            if indent != levels[-1]:
                return "foreign construct"
        expect = False
        rest = line
        first = line[0]
        if first in PY_HEAD:
            m = PY_HEAD[first].match(line)
            if not m:
                return "premature end"
            # the colon that ends the header: the first one outside a lambda
            end = header_end(line)
            if end is None:
                return "premature end"
            head, rest = line[: end + 1], line[end + 1 :]
            inner = head[1:-1]
            if first == "w" and (not inner or inner[-1] in PY_EMPTY_ENDS):
                return "premature end"
            if wrong_python(re.sub(r"^j?f?", "", head[:-1]) if first in "fj" else head[1:-1]):
                return "foreign construct"
            if not rest:
                expect = True
                continue
        elif line[-1] == ":" and re.match(r"a[^=]", line) and SOFT.match(line):  # match and case are names elsewhere
            if wrong_python(line[1:-1]):
                return "foreign construct"
            expect = True
            continue
        for part in rest.split(";") if ";" in rest else (rest,):
            if not part:
                if rest.endswith(";") and rest != ";":
                    continue
                return "foreign construct"
            if not python_line(part):
                return "premature end"
            if wrong_python(part):
                return "foreign construct"
    return "premature end" if expect else None


SOFT = re.compile(r"a(?:[anstPQB!\-*(~]|\.|k).*:$")


def header_end(line: str) -> int | None:
    """The offset of the colon that ends a header; those of lambdas belong to them."""
    lambdas = 0
    for i, c in enumerate(line):
        if c == "k":
            lambdas += 1
        elif c == ":":
            if lambdas:
                lambdas -= 1
            else:
                return i
    return None


def wrong_python(part: str) -> bool:
    return bool(PY_WRONG.search(part))


# --- languages with declarations at top level ------------------------------------------------------------------------------

JAVA_TYPE = r"(?:@a(?:\.a)*P?|m)*(?:-m)?(?:@?I|[lE]|a(?=a[P<]))a[^;B]*B;*"
JAVA_TOP = re.compile(rf"(?:@a(?:\.a)*P?)*(?:pa(?:\.[a-zA-Z])*;)?(?:;|im?[a-zA-Z](?:\.[a-zA-Z*])*;)*(?>{JAVA_TYPE})*+\Z")
JAVA_WRONG = re.compile(r"aaa(?!a?[(<])|[an]n|n[as]|[as]s|sa|ss|z|D{2}|w(?!\()|(?<![.])l(?![a.\])}>])|[=o](?=[;)\]}=])")


def java(code: str) -> None:
    text = classes_of(code, "java", False)
    text = re.sub(r"(?<=\.)[a-zA-Z]", "a", text)
    if m := JAVA_WRONG.search(text):
        raise Wrong(m.start())

    def check(opening: str, content: str, before: str) -> str | None:
        if opening == "{" and content and before[-1:] in ("P", "A", "y") and content[-1] not in ";B:,":
            raise Wrong(0)
        return None

    left = reduce_groups(text, check)
    if not JAVA_TOP.match(left):
        raise Wrong(len(left))


DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)(?:[^\n\\]|\\\n|\\.)*", re.M)
DIRECTIVES = frozenset(" include include_next import define undef if ifdef ifndef elif elifdef elifndef else endif pragma error warning line ident".split(" "))
C_WRONG = re.compile(r"aaaa|[an]n|na|ns|sn|z|w(?!\()|[aPQ]![a(s]|[=o](?=[;)\]}=])")
C_TOP = re.compile(r"(?>;|[^;B]*+(?:B;?|;)|aP(?=[amlxT]))*+(?:aP)?\Z")


def c(code: str) -> None:
    for m in DIRECTIVE.finditer(code):
        if m[1] not in DIRECTIVES:
            raise Wrong(m.start())
    text = classes_of(DIRECTIVE.sub("", code).replace("\\\n", " "), "c", False)
    if m := C_WRONG.search(text):
        raise Wrong(m.start())

    def check(opening: str, content: str, before: str) -> str | None:
        if opening == "(" and ":" in content and not re.search("[?sB]", content) and not re.search(r"S[mk]*$", before):
            raise Wrong(0)
        if opening == "{" and content and before[-1:] == "P" and content[-1] not in ";B:,":
            raise Wrong(0)
        return None

    left = reduce_groups(text, check)
    if not left:
        return
    if not C_TOP.match(left) or left[-1] not in ";BP" or (left[-1] == "P" and not re.search(r"(?:^|[;BP])aP\Z", left)):
        raise Wrong(len(left))
    for item in re.findall(r"[^;B]*(?:B;?|;)", left):
        if item[0] in "kw#" or re.search(r"^[^=]*[.?]|^[^=x]*s(?!P)|R|W|^[^=]*[kw]", item.replace("e", "")):
            if not re.match(r"(?:x?s)?aP", item):
                raise Wrong(0)
        if item.rstrip(";").endswith("B") and not re.search(r"[P=l]|x", item):
            raise Wrong(0)


GO_WRONG = re.compile(r"na|n\(|sa|sn|ss|nn|an|z|;\n*;|w(?=\n*[)\],:=])|[o+%^|/](?=\n*[)\]};,])")
GO_TOP = re.compile(r"\n*pa(?:[\n;]+(?:i(?:[a.]?s|P)|f[^\n]*|[vVT][^\n]*))*[\n;]*\Z")


def go(code: str) -> None:
    text = classes_of(re.sub("<-", " <- ", code), "go", True)
    text = re.sub(r"(?<=\.)[a-zA-Z]", "a", text)
    if m := GO_WRONG.search(text):
        raise Wrong(m.start())
    left = reduce_groups(text, lambda *_: None)
    left = re.sub(r"(?<=[=o+\-*/%&|^,.<>])\n+", "", left)
    if not GO_TOP.match(left) or re.search(r"(?:^|\n)(?:fP?[^\nB]*?(?:B[^\n]+|[-+=o,.])|f(?!P?[a(])[^\n]*|T(?!P|a)[^\n]*|Ta\n*|[vV](?![aP])[^\n]*|Va\n*|va\n*)(?:\n|\Z)", left):
        raise Wrong(len(left))


RUST_WRONG = re.compile(r"a[an]|n[an]|s[an]|ns|z|W|[=o](?=[;)\]}=])|[P](?=[ans])(?<!\]P)")
LIFETIME = re.compile(r"'[A-Za-z_]\w*")
RUST_TOP = re.compile(
    r"(?>\#!?Q|;|(?:mP?s?)*+(?:u[^;]*+;|[kVms]*+f[^;B]*+B|[kV]*+l[^;B]*+(?:B|;)|[kV]*+V[^;]*+;|V[^;]*+;|k[^;B]*+B|(?<=[ms])(?:B|a[^;]*+;)|a(?:Da)*+!a?(?:P;|B|Q;?|P)|M!a(?:B|P;?)))*+\Z"
)


def rust(code: str) -> None:
    text = classes_of(LIFETIME.sub("``", code), "rust", False)  # a lifetime stands where raw strings can't
    text = without_macros(re.sub(r"(?<=\.)[a-zA-Z]", "a", text))
    if m := RUST_WRONG.search(text):
        raise Wrong(m.start())
    if not RUST_TOP.match(left := reduce_groups(text, lambda *_: None)):
        raise Wrong(len(left))


MACRO = re.compile(r"[aM]!a?([(\[{])")
CLOSING = {"(": ")", "[": "]", "{": "}"}


def without_macros(text: str) -> str:
    """Without what stands in the brackets of macro calls: any tokens may."""
    out, at = [], 0
    while m := MACRO.search(text, at):
        out.append(text[at : m.end()])
        depth, i = 1, m.end()
        while depth and i < len(text):
            if text[i] in "([{":
                depth += 1
            elif text[i] in ")]}":
                depth -= 1
            i += 1
        out.append(text[i - 1 : i])
        at = i
    out.append(text[at:])
    return "".join(out)


RUBY_WRONG = re.compile(r"P:(?!:)|PA|l[a-zA-Z](?:Da)*:(?!:)|z|W|[aP]\{\n*a:(?!:)|n[as]|s(?:a)|R\n*\{\n*[^\n}]*;|w[^\n?]*:\n|\}a(?![?:=])|[=+*%&|^,.]\n*\Z|f\n*\Z|l\n*\Z")


def ruby(code: str) -> None:
    text = classes_of(code, "ruby", True)
    text = re.sub(r"(?<=\.)[a-zA-Z!]", "a", text)
    if m := RUBY_WRONG.search(text):
        raise Wrong(m.start())


FORMS: dict[str, Callable[[str], None]] = {
    "javascript": lambda x: script(x, "javascript"), "typescript": lambda x: script(x, "typescript"), "tsx": lambda x: script(x, "tsx"),
    "java": java, "c": c, "go": go, "rust": rust, "ruby": ruby,
}


def failure(code: str, language: str) -> str | None:
    """What is wrong with the statements of code whose literals and brackets are in order."""
    if language == "python":
        return python(code)
    try:
        FORMS[language](code)
    except Wrong as e:
        return "premature end" if e.args[0] else "foreign construct"
    return None
