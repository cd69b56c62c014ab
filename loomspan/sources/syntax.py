"""Concrete syntax trees of languages with braces, also of files that do not parse.

A file is cut into leaves; a table of each language's words says what its declarations
and statements are made of, and expressions are built by operator precedence. Brackets that are open
stand on a stack: a closer that an outer bracket waits for ends all inner ones, each with a MISSING node
of no width, and one that none waits for becomes an ERROR node, as does every leaf that cannot stand where it is. So
each file has a tree, every leaf is in it once, and what is wrong has a place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

ERROR, MISSING = "ERROR", "MISSING"
_LEAF = re.compile(
    r"(?P<comment>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(?P<number>\d[\w.]*)|(?P<identifier>[^\W\d]\w*)"
    r"|(?P<mark>\.\.\.|<<=|>>=|===|!==|:=|<-|=>|->|\+\+|--|&&|\|\||\?\?|\?\.|::|[-+*/%&|^=!<>]=|<<|[^\w\s])"
)
#: Words inside of forms, leaves of their own kind as well as the words that begin forms.
WORDS = frozenset("else of in as from extends implements throws instanceof range new await async typeof void delete yield throw keyof".split())
_CLOSER = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Grammar:
    """What a language's words begin. A form is the node's type and its parts in order.

    Parts: ``name`` one identifier; ``x(`` a bracket, ``x{`` a block, ``x{*`` a body of members, each with its field; ``x~`` a type, up to
    what ends it; ``x:`` an expression, ``x,`` several; ``else`` a branch; ``?`` in front: may be absent; ``=x`` an equals sign and an expression;
    ``word`` in quotes: that word.
    """

    forms: dict[str, tuple[str, str]]
    modifiers: frozenset[str]
    newline_ends: bool  # a line's end ends a statement where an expression is complete
    semicolons: bool  # a statement without a semicolon lacks one
    literals: bool  # a type before a brace makes a literal
    methods: bool  # members are told by what follows their name
    unary_words: frozenset[str] = frozenset()


_w = lambda s: frozenset(s.split())
_FLOW = {
    "if": ("if_statement", "condition: body{ else"), "for": ("for_statement", "header~ body{"), "while": ("while_statement", "condition: body{"), "do": ("do_statement", "body{ 'while' condition:"),
    "switch": ("switch_statement", "?value: body{"), "return": ("return_statement", "?value,"), "break": ("break_statement", "?name"), "continue": ("continue_statement", "?name"),
    "case": ("case_clause", "?value, 'mark'"), "default": ("case_clause", "'mark'"),
}
_TRY = {"try": ("try_statement", "?resources( body{"), "catch": ("catch_clause", "?parameter( body{"), "finally": ("finally_clause", "body{"), "throw": ("throw_statement", "value:")}
_CLASS = "name ?heritage~ body{*"
#: The words of each language and the parts that follow them.
GRAMMARS = {
    "go": Grammar(
        _FLOW | {
            "package": ("package_clause", "name"), "import": ("import_declaration", "imports"), "func": ("function_declaration", "?receiver( ?name ?types[ parameters( ?result~ ?body{"),
            "type": ("type_declaration", "name type~ ?body{*"), "var": ("variable_declaration", "names"), "const": ("constant_declaration", "names"),
            "go": ("go_statement", "value:"), "defer": ("defer_statement", "value:"), "select": ("select_statement", "body{"), "fallthrough": ("fallthrough_statement", ""), "goto": ("goto_statement", "name"),
        },
        frozenset(), True, False, True, False, _w("range"),
    ),
    "java": Grammar(
        _FLOW | _TRY | {
            "package": ("package_clause", "path~"), "import": ("import_declaration", "path~"), "class": ("class_declaration", _CLASS), "interface": ("interface_declaration", _CLASS),
            "enum": ("enum_declaration", _CLASS), "record": ("record_declaration", "name ?types~ ?parameters( ?heritage~ body{*"), "assert": ("assert_statement", "value:"), "synchronized": ("synchronized_statement", "lock( body{"),
        },
        _w("public private protected static final abstract native transient volatile strictfp sealed default"), False, True, False, True, _w("new throw"),
    ),
    "typescript": Grammar(
        _FLOW | _TRY | {
            "import": ("import_declaration", "path~"), "class": ("class_declaration", _CLASS), "interface": ("interface_declaration", _CLASS), "enum": ("enum_declaration", "name body{*"),
            "function": ("function_declaration", "?name ?types~ parameters( ?result~ ?body{"), "const": ("variable_declaration", "names"), "let": ("variable_declaration", "names"), "var": ("variable_declaration", "names"),
            "type": ("type_declaration", "name ?types~ =type"), "namespace": ("namespace_declaration", "name body{"),
        },
        _w("export default declare async abstract public private protected static readonly override"), True, False, False, True, _w("new await async typeof void delete yield throw keyof"),
    ),
}
#: Infix operators from the loosest to the tightest; the first two levels group to the right.
LEVELS = (_w("= := += -= *= /= %= &= |= ^= <<= >>= <-"), _w("? =>"), _w("?? ||"), _w("&&"), _w("|"), _w("^"), _w("&"), _w("== != === !== instanceof in as"), _w("< > <= >="), _w("<< >>"), _w("+ -"), _w("* / %"))
_TIGHT = {op: k for k, level in enumerate(LEVELS) for op in level}
_UNARY = _w("- + ! ~ * & <- ... ++ --")


KEYWORDS = WORDS.union(*(g.forms for g in GRAMMARS.values()))


def is_named(type_: str) -> bool:
    """Whether nodes of a type are more than a mark or a word of the language."""
    return (type_[:1].isalpha() or type_[:1] == "_") and type_ not in KEYWORDS


@dataclass
class Node:
    type: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    field: str = ""

    def add(self, child: Node | None, name: str = "") -> Node:
        if child is not None:
            child.field = name or child.field
            self.children.append(child)
            self.start, self.end = min(self.start, child.start), max(self.end, child.end)
        return self


class Tree:
    """The tree of one text; offsets are characters."""

    def __init__(self, text: str, language: str):
        self.g = GRAMMARS[language]
        found = [(m.lastgroup, m.start(), m.end()) for m in _LEAF.finditer(text)]
        self.comments = [Node("comment", a, b) for kind, a, b in found if kind == "comment"]
        self.leaves = [(kind, text[a:b], a, b) for kind, a, b in found if kind != "comment"]
        # whether a leaf is the first of its line
        self.fresh = [k > 0 and "\n" in text[self.leaves[k - 1][3] : x[2]] for k, x in enumerate(self.leaves)]
        self.at, self.waiting, self.size = 0, [], len(text)
        self.root = Node("source_file", 0, 0)
        try:
            self.statements(self.root, None)
        except RecursionError:  # nested too deeply: all leaves are wrong
            self.at, self.root = 0, Node("source_file", 0, 0, [wrong := Node(ERROR, 0, self.size)])
            wrong.children = [Node(x[1] if x[0] == "mark" else x[0], *x[2:]) for x in self.leaves]
        self.root.end = self.size
        for c in self.comments:
            self._comment(c)

    # --- leaves

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.leaves[k][1] if k < len(self.leaves) else ""

    def kind(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.leaves[k][0] if k < len(self.leaves) else ""

    def take(self, type_: str = "") -> Node:
        kind, text, a, b = self.leaves[self.at]
        self.at += 1
        return Node(type_ or (text if kind == "mark" or text in WORDS or (kind == "identifier" and text in self.g.forms) else kind), a, b)

    def missing(self) -> Node:
        at = self.leaves[self.at - 1][3] if self.at else 0
        return Node(MISSING, at, at)

    def open(self, type_: str) -> Node:
        at = self.leaves[self.at][2] if self.at < len(self.leaves) else self.size
        return Node(type_, at, at)

    def ended(self) -> bool:
        """Whether a statement can end here."""
        return self.peek() in ("", ";", "}", ")", "]", ",", ":") or (self.g.newline_ends and self.at < len(self.leaves) and self.fresh[self.at])

    def close(self, out: Node) -> Node:
        """The closer of the innermost open bracket; what stands before it is wrong, unless an outer bracket waits for it."""
        want = self.waiting.pop()
        while self.peek() and self.peek() != want and self.peek() not in self.waiting:
            out.add(Node(ERROR, (x := self.take()).start, x.end, [x]))
        return out.add(self.take() if self.peek() == want else self.missing())

    def _comment(self, c: Node) -> None:
        at = self.root
        while True:
            inner = next((x for x in at.children if x.children and x.start <= c.start and c.end <= x.end), None)
            if inner is None:
                break
            at = inner
        k = sum(x.start < c.start for x in at.children)
        at.children.insert(k, c)

    # --- statements

    def statements(self, out: Node, until: str | None) -> None:
        while self.peek() and self.peek() != until:
            if self.peek() == ";":
                out.add(self.take())
            elif self.peek() in (")", "]", "}"):
                if self.peek() in self.waiting:
                    return
                out.add(Node(ERROR, (x := self.take()).start, x.end, [x]))
            else:
                before = self.at
                out.add(self.statement())
                if self.at == before:
                    out.add(Node(ERROR, (x := self.take()).start, x.end, [x]))

    def block(self, members: bool = False) -> Node:
        out = self.open("body" if members else "block").add(self.take())
        self.waiting.append("}")
        if members:
            self.members(out)
        else:
            self.statements(out, "}")
        return self.close(out)

    def statement(self) -> Node:
        modifiers = self.modifiers()
        out = self.unmodified(modifiers)
        if modifiers and not any(c is modifiers[0] for c in out.children):
            out.start, out.children = modifiers[0].start, [*modifiers, *out.children]
        return out

    def unmodified(self, modifiers: list[Node]) -> Node:
        word = self.peek()
        if modifiers and word not in self.g.forms:
            out = self.member(modifiers) if self.g.methods else Node("expression_statement", modifiers[0].start, 0).add(self.expression(0))
        elif word == "{":
            return self.block()
        elif word in self.g.forms and self.kind() == "identifier" and not (word == "type" and self.peek(1) in ("=", ".", "(", ":", ")")):
            out = self.form(*self.g.forms[word], modifiers)
            if out.children[-1].type in ("block", "body") or out.type == "case_clause" or out.children[-1].type.endswith("_statement"):
                return out
        elif self._typed():
            out = self.open("variable_declaration").add(self.type_("", 1), "type")
            self.declared(out)
        elif self.kind() == "identifier" and self.peek(1) == ":" and self.peek(2) != ":":
            return self.open("labeled_statement").add(self.take(), "name").add(self.take())
        else:
            out = self.open("expression_statement").add(self.expression(0))
            while self.peek() == ",":  # a, b = f()
                out.add(self.take()).add(self.expression(0))
        if self.peek() == ";":
            return out.add(self.take())
        if self.g.semicolons and out.type not in ("source_file",):
            return out.add(self.missing())
        if not self.ended():
            wrong = self.open(ERROR)
            while self.peek() and not self.ended() and self.peek() not in ("{", ";"):
                wrong.add(self.take())
            out.add(wrong if wrong.children else None)
        return out

    def modifiers(self) -> list[Node]:
        out = []
        while (self.peek() in self.g.modifiers and self.peek(1) not in ("(", "=", ".", ":", ")", "->")) or (self.peek() == "@" and self.kind(1) == "identifier" and self.g.methods):
            if self.peek() == "@":
                note = self.open("annotation").add(self.take()).add(self.take(), "name")
                while self.peek() == ".":
                    note.add(self.take()).add(self.take())
                out.append(note.add(self.group("arguments")) if self.peek() == "(" else note)
            else:
                out.append(self.take("modifier"))
        return out

    def _typed(self) -> bool:
        """Whether a type and a name stand here: ``A<B>[] name`` followed by what a declaration goes on with."""
        if not self.g.semicolons or self.kind() != "identifier" or self.peek() in self.g.unary_words:
            return False
        k = self._past_type(0)
        return k is not None and self.kind(k) == "identifier" and self.peek(k) not in ("instanceof",) and self.peek(k + 1) in ("=", ";", ",", ":")

    def _past_type(self, k: int) -> int | None:
        if self.kind(k) != "identifier":
            return None
        k += 1
        while self.peek(k) == "." and self.kind(k + 1) == "identifier":
            k += 2
        if self.peek(k) == "<":
            depth = 0
            while self.peek(k):
                depth += {"<": 1, ">": -1, ">>": -2}.get(self.peek(k), 0)
                if self.peek(k) in (";", "{", "}", "(", ")"):
                    return None
                k += 1
                if depth <= 0:
                    break
        while self.peek(k) == "[" and self.peek(k + 1) == "]":
            k += 2
        return k

    def form(self, type_: str, parts: str, modifiers: list[Node]) -> Node:
        out = self.open(type_)
        for m in modifiers:
            out.start = min(out.start, m.start)
            out.add(m)
        out.add(self.take())
        for part in parts.split():
            may, part = part.startswith("?"), part.lstrip("?")
            name, mark = part.rstrip("({[~:,*"), part[-1]
            if part == "name":
                if self.kind() == "identifier" and not (may and self.ended()):
                    out.add(self.take("identifier"), "name")
                elif not may:
                    out.add(self.missing(), "name")
            elif part == "else":
                if self.peek() == "else":
                    out.add(self.take())
                    out.add(self.statement() if self.peek() != "{" else self.block(), "alternative")
            elif part == "imports":
                self.imports(out)
            elif part == "names":
                self.declared(out)
            elif part == "'mark'":
                out.add(self.take() if self.peek() in (":", "->") else self.missing())
            elif part.startswith("'"):
                out.add(self.take() if self.peek() == part.strip("'") else self.missing())
            elif part.startswith("="):
                out.add(self.take() if self.peek() == "=" else self.missing())
                out.add(self.type_("", 0), part[1:])
            elif mark in "([":
                if self.peek() == mark:
                    out.add(self.group("parameters" if name == "parameters" else "list", flat=name in ("parameters", "receiver", "types", "parameter", "resources")), name)
                elif not may:
                    out.add(self.missing(), name)
            elif mark in "{*":
                if self.peek() == "{":
                    out.add(self.block(mark == "*"), name)
                elif not may and mark == "{" and type_ in ("if_statement", "for_statement", "while_statement", "do_statement") and not self.g.literals and not self.peek() == "}":
                    out.add(self.statement(), name)
                elif not may:
                    out.add(self.missing(), name)
            elif part == "types~":
                out.add(self.angled("types") if self.peek() == "<" else None, name)
            elif part == "header~":
                out.add(self.header(), name)
            elif mark == "~":
                own = self.type_("{" if name != "path" else "", 0, commas=name == "heritage")
                out.add(own if own.children else None if may else self.missing(), name)
            elif may and self.ended():
                continue
            elif mark == ":":
                out.add(self.expression(0, braces=False), name)
                while name == "condition" and self.peek() == ";":
                    out.add(self.take()).add(self.expression(0, braces=False), name)
            else:
                out.add(self.expression(0), name)
                while self.peek() == ",":
                    out.add(self.take()).add(self.expression(0), name)
        return out

    def imports(self, out: Node) -> None:
        def spec() -> Node:
            own = self.open("import_spec")
            if self.kind() == "identifier" or self.peek() == ".":
                own.add(self.take(), "name")
            return own.add(self.take() if self.kind() == "string" else self.missing(), "path")

        if self.peek() != "(":
            out.add(spec())
            return
        own = self.open("list").add(self.take())
        self.waiting.append(")")
        while self.peek() and self.peek() not in self.waiting:
            before = self.at
            own.add(self.take() if self.peek() == ";" else spec())
            if self.at == before:
                own.add(Node(ERROR, (x := self.take()).start, x.end, [x]))
        out.add(self.close(own))

    def declared(self, out: Node) -> None:
        """Names with types and values, after the word or the type that declares them; in brackets, several."""
        if self.peek() == "(" and self.g.literals:
            own = self.open("list").add(self.take())
            self.waiting.append(")")
            while self.peek() and self.peek() not in self.waiting:
                before = self.at
                one = self.open("variable_spec")
                self.declared(one)
                own.add(one)
                if self.peek() == ";":
                    own.add(self.take())
                if self.at == before:
                    own.add(Node(ERROR, (x := self.take()).start, x.end, [x]))
            out.add(self.close(own))
            return
        while True:
            if self.peek() in ("{", "["):
                out.add(self.group("pattern"), "name")
            else:
                out.add(self.take("identifier") if self.kind() == "identifier" else self.missing(), "name")
            if (self.peek() == ":" and not self.g.semicolons) or (self.g.literals and not self.ended() and self.peek() not in ("=", ",")):
                out.add(self.type_("", 0), "type")
            if self.peek() == "=":
                out.add(self.take()).add(self.expression(1), "value")
                while self.g.literals and self.peek() == ",":  # names come first, then as many values
                    out.add(self.take()).add(self.expression(1), "value")
            if self.peek() != ",":
                return
            out.add(self.take())

    def type_(self, stop: str, least: int, commas: bool = False) -> Node:
        """A type as a flat node: whole brackets, up to a brace, an equals sign or the statement's end. ``least``: exactly what _past_type tells."""
        out = self.open("type")
        if least:
            end = self.at + (self._past_type(0) or 1)
            while self.at < end:
                out.add(self.take())
            return out
        while self.peek() and not (self.peek() in (")", "]", "}") or self.peek() == stop):
            if self.peek() in (";", "=", ":=") or (self.peek() == "," and not commas):
                break
            if out.children and self.g.newline_ends and self.fresh[self.at] and self.peek() not in ("|", "&"):
                break
            last = self.leaves[self.at - 1][1] if out.children else ""
            if self.peek() in ("(", "["):
                out.add(self.group("list", flat=True))
            elif self.peek() == "{":
                if stop != "{" and not self.g.literals and (last in ("=", "|", "&", ":", "=>", "from", "type") or not out.children):
                    out.add(self.group("list", flat=True))
                elif stop == "" and last in ("import", ",", "struct", "interface") or (stop == "" and not out.children):
                    out.add(self.block(True) if last in ("struct", "interface") else self.group("list", flat=True))
                else:
                    break
            else:
                out.add(self.take())
        return out

    # --- members of types

    def members(self, out: Node) -> None:
        while self.peek() and self.peek() not in ("}",) and self.peek() not in self.waiting:
            before = self.at
            if self.peek() in (";", ","):
                out.add(self.take())
                continue
            modifiers = self.modifiers()
            word = self.g.forms.get(self.peek())
            if word and word[0].endswith("_declaration") and self.kind(1) == "identifier" and self.g.methods:
                out.add(self.form(*word, modifiers))
            elif self.peek() == "{" and not modifiers:
                out.add(self.block())
            else:
                out.add(self.member(modifiers))
            if self.at == before:
                out.add(Node(ERROR, (x := self.take()).start, x.end, [x]))

    def member(self, modifiers: list[Node]) -> Node:
        """A field or a method: a type before the name in one language, after it in others."""
        out = self.open("field_declaration")
        for m in modifiers:
            out.start = min(out.start, m.start)
            out.add(m)
        if self.g.semicolons:
            if self.peek() == "<":
                while self.peek() and self.leaves[self.at - 1][1] != ">":
                    out.add(self.take())
            k = self._past_type(0)
            if k is not None and self.kind(k) == "identifier":
                out.add(self.type_("", 1), "type")
        if self.kind() != "identifier" and self.kind() != "string":
            while self.peek() and not self.ended():
                out.add(self.group("list", flat=True) if self.peek() in _CLOSER else self.take())
            if self.peek() == ";":
                out.add(self.take())
            return out
        out.add(self.take("identifier" if self.kind() == "identifier" else ""), "name")
        if self.peek() in ("?", "!"):
            out.add(self.take())
        if self.peek() == "<" and not self.g.semicolons:
            while self.peek() and self.leaves[self.at - 1][1] != ">":
                out.add(self.take())
        if self.peek() == "(":
            out.type = "method_declaration"
            out.add(self.group("parameters", flat=True), "parameters")
            if self.peek() in (":", "throws", "default") or (self.g.literals and not self.ended()):
                out.add(self.type_("{", 0), "result")
            if self.peek() == "{":
                return out.add(self.block(), "body")
        elif self.peek() == ":" or (self.g.literals and not self.ended()):
            out.add(self.type_("", 0), "type")
        while self.peek() == "," and self.g.semicolons:
            out.add(self.take()).add(self.take("identifier") if self.kind() == "identifier" else self.missing(), "name")
        if self.peek() == "=":
            out.add(self.take()).add(self.expression(1), "value")
        if self.peek() == ";":
            return out.add(self.take())
        if self.g.semicolons and self.peek() not in (",", "}", ""):
            out.add(self.missing())
        return out

    # --- expressions

    def group(self, type_: str, flat: bool = False) -> Node:
        """A bracket and what it holds: expressions between commas, or (flat) leaves and inner brackets with one node for each part."""
        out = self.open(type_)
        self.waiting.append(_CLOSER[self.peek()])
        out.add(self.take())
        part = None
        while self.peek() and self.peek() not in self.waiting:
            before = self.at
            if self.peek() in (",", ";"):
                out.add(self.take())
                part = None
            elif self.peek() in (")", "]", "}"):
                break
            elif flat:
                if part is None:
                    out.add(part := self.open("parameter" if type_ == "parameters" else "part"))
                part.add(self.group("list", flat=True) if self.peek() in _CLOSER else self.take("identifier" if self.kind() == "identifier" and self.peek() not in self.g.forms else ""))
                out.end = part.end
            elif type_ == "object" and self.kind() == "identifier" and self.peek(1) == "(" and self.peek(self._matching(1) + 1) == "{":
                out.add(self.member([]))
            elif self.kind() in ("identifier", "string", "number") and self.peek(1) == ":" and type_ != "arguments":
                pair = self.open("pair").add(self.take(), "key").add(self.take())
                out.add(pair.add(self.expression(1), "value"))
            else:
                out.add(self.expression(0))
                if self.peek() == ":":  # a slice
                    out.add(self.take())
            if self.at == before:
                out.add(Node(ERROR, (x := self.take()).start, x.end, [x]))
        return self.close(out)

    def _matching(self, k: int) -> int:
        """The place of the closer of the bracket ``k`` leaves ahead."""
        depth = 0
        while self.peek(k):
            depth += (self.peek(k) in "([{") - (self.peek(k) in ")]}")
            if not depth:
                return k
            k += 1
        return k

    def _arrow(self) -> bool:
        """Whether the bracket here holds the parameters of a function."""
        k = self._matching(0) + 1
        if self.peek(k) in ("=>", "->"):
            return True
        return self.peek(k) == ":" and not self.g.literals and not self.g.semicolons and any(self.peek(j) == "=>" for j in range(k + 2, k + 12) if not {"{", ";", ")"} & {self.peek(i) for i in range(k + 1, j)})

    def header(self) -> Node:
        """What a loop goes over: declarations and expressions between marks, in brackets or up to the brace."""
        out, bracket = self.open("header"), self.peek() == "(" and not self.g.literals
        if bracket:
            out.add(self.take())
            self.waiting.append(")")
        while self.peek() and self.peek() not in (")", "}") and (bracket or self.peek() != "{"):
            before = self.at
            if self.peek() in (";", ",", ":", "of", "in"):
                out.add(self.take())
            elif self.g.forms.get(self.peek(), ("",))[0] == "variable_declaration":
                out.add(self.form(*self.g.forms[self.peek()], []))
            elif self._typed():
                own = self.open("variable_declaration").add(self.type_("", 1), "type")
                self.declared(own)
                out.add(own)
            else:
                out.add(self.expression(0, braces=False))
            if self.at == before:
                out.add(Node(ERROR, (x := self.take()).start, x.end, [x]))
        return self.close(out) if bracket else out

    def angled(self, type_: str) -> Node:
        """Type parameters between angle brackets."""
        out, depth = self.open(type_), 0
        while self.peek() and self.peek() not in ("{", ";", "(", ")"):
            depth += {"<": 1, ">": -1, ">>": -2}.get(self.peek(), 0)
            out.add(self.take())
            if depth <= 0:
                break
        return out

    def expression(self, least: int, braces: bool = True) -> Node:
        left = self.operand(braces)
        while self.peek() in _TIGHT and _TIGHT[self.peek()] >= least and not (self.g.newline_ends and self.fresh[self.at] and (self.g.literals or self.kind() == "identifier")):
            op, level = self.peek(), _TIGHT[self.peek()]
            if op == "?" and self.g.literals:
                break
            own = Node("assignment_expression" if level == 0 else "conditional_expression" if op == "?" else "lambda_expression" if op == "=>" else "binary_expression", left.start, left.end)
            own.add(left, "parameters" if op == "=>" else "condition" if op == "?" else "left").add(self.take(), "operator")
            if op == "=>":
                own.add(self.block() if self.peek() == "{" else self.expression(1), "body")
            elif op == "?":
                own.add(self.expression(1), "consequence")
                own.add(self.take() if self.peek() == ":" else self.missing()).add(self.expression(1), "alternative")
            else:
                own.add(self.expression(level + (level > 1), braces), "right")
            left = own
        return left

    def operand(self, braces: bool) -> Node:
        kind, text = self.kind(), self.peek()
        if text == "new" and text in self.g.unary_words and self._past_type(1):
            self.at, start = self.at + 1, self.at
            type_ = self.type_("", 1)
            after, self.at = self.at, start
            out = self.open("unary_expression").add(self.take(), "operator")
            self.at = after
            return out.add(self.suffixes(type_, braces), "value")
        if text in _UNARY or text in self.g.unary_words:
            out = self.open("unary_expression").add(self.take(), "operator")
            return out.add(self.expression(len(LEVELS), braces), "value")
        if text in ("func", "function"):
            out = self.form("function_literal", "parameters( ?result~ body{" if self.g.literals else "?name ?types~ parameters( ?result~ body{", [])
        elif text == "(" and self._arrow():
            out = self.group("parameters", flat=True)
            if self.peek() == ":":
                out.add(self.typed_result(), "result")
            return out if self.peek() == "=>" else self.suffixes(out, braces)
        elif text == "(":
            out = self.group("parenthesized")
        elif text == "[":
            out = self.group("list")
            if self.g.literals and self.kind() == "identifier" and not self.ended():
                out = Node("type", out.start, out.end).add(out)
                while self.kind() == "identifier" or self.peek() in ("*", ".", "["):
                    out.add(self.group("list") if self.peek() == "[" else self.take())
        elif text == "{" and braces:
            out = self.group("object")
        elif kind in ("identifier", "string", "number") and not (kind == "identifier" and text in self.g.forms and text not in ("default", "type", "package")):
            out = self.take("identifier" if kind == "identifier" else "")
        elif text in ("map", "struct", "chan", "interface"):
            out = self.take("identifier")
        else:
            return self.missing()
        return self.suffixes(out, braces)

    def typed_result(self) -> Node:
        out = self.open("type").add(self.take())
        while self.peek() and self.peek() not in ("=>", ";", "{", "}", ")"):
            out.add(self.group("list", flat=True) if self.peek() in _CLOSER else self.take())
        return out

    def suffixes(self, out: Node, braces: bool) -> Node:
        while self.peek():
            mark, own = self.peek(), Node("", out.start, out.end)
            new_line = self.g.newline_ends and self.fresh[self.at]
            if mark in (".", "?.", "::"):
                own.type = "member_expression"
                own.add(out, "object").add(self.take())
                if self.peek() == "(":
                    own.add(self.group("list"), "property")
                else:
                    own.add(self.take("identifier") if self.kind() == "identifier" else self.missing(), "property")
            elif mark == "(" and not new_line:
                own.type = "call_expression"
                own.add(out, "function").add(self.group("arguments"), "arguments")
            elif mark == "[" and not new_line:
                own.type = "index_expression"
                own.add(out, "object").add(self.group("list"), "index")
            elif mark in ("++", "--") and not new_line:
                own.type = "update_expression"
                own.add(out, "value").add(self.take(), "operator")
            elif mark == "->" and self.g.semicolons:
                own.type = "lambda_expression"
                own.add(out, "parameters").add(self.take(), "operator").add(self.block() if self.peek() == "{" else self.expression(1), "body")
            elif mark == "!" and not self.g.literals and not new_line and self.peek(1) in (".", ")", ";", "[", ","):
                own.type = "non_null_expression"
                own.add(out, "value").add(self.take())
            elif mark == "{" and braces and self.g.literals and out.type in ("identifier", "member_expression", "index_expression", "type") and not new_line:
                own.type = "literal_expression"
                own.add(out, "type").add(self.group("object"), "value")
            elif mark == "{" and self.g.semicolons and (out.type == "type" or (out.type == "index_expression" and out.children[0].type == "type")):
                own.type = "literal_expression"
                own.add(out, "type").add(self.group("object"), "value")
            elif mark == "{" and braces and self.g.semicolons and out.type == "call_expression":
                own.type = "class_expression"
                own.add(out, "object").add(self.block(True), "body")
            else:
                return out
            out = own
        return out


def rows(text: str, language: str) -> list[tuple]:
    """(node_id, parent_id, type, start, end, depth, field) in order, parents before their children; offsets are characters."""
    out: list[tuple] = []
    todo = [(Tree(text, language).root, -1, 0)]
    while todo:
        node, parent, depth = todo.pop()
        out.append((len(out), parent, node.type, node.start, node.end, depth, node.field))
        todo.extend((c, len(out) - 1, depth + 1) for c in reversed(node.children))
    return out
