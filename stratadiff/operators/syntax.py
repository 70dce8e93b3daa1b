"""Syntax trees of scripts as a table, and questions about them as joins of intervals.

Each script is parsed where it is into rows (keys, node, last, parent, depth, kind, field, first, upto, first_line, last_line, value): nodes
are numbered as they begin, ``last`` is the greatest number below a node, so a node lies in another one if its number is between that one's
number and last. first and upto are places of characters, lines count from 1; value is the text of names, literals and operators. Kinds and
fields have the names that grammars of the language commonly give them. Comments are nodes of what they stand in. What the
grammar does not allow becomes an ``ERROR`` node up to the end of its line (or of the brackets open there), and parsing goes on behind it.

Functions, statements around a line and names by scope are then Spark's work: equal joins on the script and intervals of nodes.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratadiff.operators.graphs import _dealt

NODES = "node int, last int, parent int, depth int, kind string, field string, first int, upto int, first_line int, last_line int, value string, role string, scope int, scope_last int, up string, inside int"
#: Rows that a task hands on at once.
ROWS = 20_000
FUNCTION_KINDS = ("function_declaration", "generator_function_declaration", "function_expression", "generator_function", "arrow_function", "method_definition")

_SKIP = re.compile(r"(?:[\s﻿]+|//[^\n]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*)+", re.S)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*", re.S)
_TOKEN = re.compile(
    r"(?P<name>\#?(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4})*)"
    r"|(?P<number>0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<string>'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\")"
    r"|(?P<mark>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@`])",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = set("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
#: Words that no expression begins with, so they are no names.
_RESERVED = set("break case catch const continue debugger default do else export extends finally for if in instanceof return switch throw try var while with enum".split())


class Wrong(Exception):
    pass


class Node:
    __slots__ = ("kind", "first", "upto", "value", "below")

    def __init__(self, kind: str, first: int, value: str | None = None):
        self.kind, self.first, self.upto, self.value = kind, first, first, value
        self.below: list[tuple[str, Node]] = []


class Parser:
    """One script's tree by descent; binary operators by their strength. Parentheses are read as expressions and become parameters
    where an arrow follows."""

    def __init__(self, code: str):
        self.code, self.comments = code, []
        self.end = 0
        self.move(0)

    def move(self, at: int) -> None:
        """The token at or behind a place becomes the next one."""
        skipped = _SKIP.match(self.code, at)
        self.gap = False
        if skipped:
            for m in _COMMENT.finditer(self.code, at, skipped.end()) if "/" in skipped[0] or at == 0 else ():
                if not self.comments or m.start() > self.comments[-1].first:
                    note = Node("comment", m.start())
                    note.upto = m.end()
                    self.comments.append(note)
            self.gap = "\n" in skipped[0] or "\r" in skipped[0]
            at = skipped.end()
        self.at = at
        m = _TOKEN.match(self.code, at)
        if m:
            self.type, self.text, self.stop = m.lastgroup, m[0], m.end()
        elif at >= len(self.code):
            self.type, self.text, self.stop = "end", "", at
        else:
            self.type, self.text, self.stop = "wrong", self.code[at], at + 1

    def next(self) -> str:
        text, self.end = self.text, self.stop
        self.move(self.stop)
        return text

    def peek(self) -> tuple[str, str, bool]:
        """Type and text of the token after the next one, and whether a line ends before it."""
        kept = self.at, self.type, self.text, self.stop, self.gap
        self.move(self.stop)
        out = self.type, self.text, self.gap
        self.at, self.type, self.text, self.stop, self.gap = kept
        return out

    def is_(self, *texts: str) -> bool:
        return self.type in ("mark", "name") and self.text in texts

    def eat(self, text: str) -> bool:
        if self.is_(text):
            self.next()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            raise Wrong

    def close(self, node: Node) -> Node:
        node.upto = max(self.end, node.first)
        return node

    def leaf(self, kind: str) -> Node:
        node = Node(kind, self.at, self.text)
        self.next()
        return self.close(node)

    @staticmethod
    def add(node: Node, below: Node | None, field: str = "") -> Node:
        if below is not None:
            node.below.append((field, below))
        return node

    def over(self, kind: str, *below: tuple[str, Node], value: str | None = None) -> Node:
        node = Node(kind, below[0][1].first, value)
        node.below.extend(below)
        return self.close(node)

    # --- statements -----------------------------------------------------------------------------------------------------
    def program(self) -> Node:
        node = Node("program", 0)
        self.body(node, "")
        node.upto = len(self.code)
        return node

    def body(self, node: Node, closing: str) -> None:
        while self.type != "end" and not (closing and self.is_(closing, "case", "default") and (closing != "}" or self.text == "}" or node.kind.startswith("switch_"))):
            at, held = self.at, self.end
            try:
                self.add(node, self.statement())
            except (Wrong, RecursionError):
                self.add(node, self.skipped(at, held))

    def skipped(self, at: int, held: int) -> Node:
        """An error from a place up to the end of the line at which no bracket opened since then is still open."""
        self.move(at)
        self.end = held
        node, depth = Node("ERROR", self.at), 0
        while self.type != "end":
            if self.at > node.first and not depth and (self.gap or self.is_("}")):
                break
            depth = max(0, depth + (self.text in ("(", "[", "{")) - (self.text in (")", "]", "}"))) if self.type == "mark" else depth
            done = self.is_(";") and not depth
            self.next()
            if done:
                break
        return self.close(node)

    def block(self, kind: str = "statement_block") -> Node:
        node = Node(kind, self.at)
        self.need("{")
        self.body(node, "}")
        self.need("}")
        return self.close(node)

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.gap or self.type == "end" or self.is_("}")):
            raise Wrong

    def statement(self) -> Node:
        text, node = self.text, Node("", self.at)
        if self.type == "mark":
            if text == "{":
                return self.block()
            if text == ";":
                node.kind = "empty_statement"
                self.next()
                return self.close(node)
            if text == "@":
                return self.class_("class_declaration")
        if self.type == "name":
            rule = getattr(self, f"_{text}", None) if text in self.RULES else None
            if rule:
                found = rule(node)
                if found is not None:
                    return self.close(found)
            elif self.peek()[:2] == ("mark", ":") and text not in _RESERVED:
                node.kind = "labeled_statement"
                self.add(node, self.leaf("statement_identifier"), "label")
                self.need(":")
                return self.close(self.add(node, self.statement(), "body"))
        node.kind = "expression_statement"
        self.add(node, self.expression())
        self.semicolon()
        return self.close(node)

    RULES = frozenset("var let const function async class if for while do return break continue throw try switch import export debugger with".split())

    def _var(self, node: Node, semicolon: bool = True) -> Node | None:
        kind, word = self.text, self.peek()
        if kind == "let" and not (word[0] == "name" and word[1] not in ("in", "instanceof", "of") or word[1] in ("[", "{")):
            return None
        node.kind = "variable_declaration" if kind == "var" else "lexical_declaration"
        self.next()
        while True:
            one = Node("variable_declarator", self.at, kind)
            self.add(one, self.pattern(), "name")
            if self.eat("="):
                self.add(one, self.assignment(not semicolon), "value")
            self.add(node, self.close(one))
            if not self.eat(","):
                break
        if semicolon:
            self.semicolon()
        return self.close(node)

    _let = _const = _var

    def _function(self, node: Node) -> Node:
        return self.function("function_declaration")

    def _async(self, node: Node) -> Node | None:
        word = self.peek()
        return self.function("function_declaration") if word[1] == "function" and not word[2] else None

    def _class(self, node: Node) -> Node:
        return self.class_("class_declaration")

    def condition(self) -> Node:
        node = Node("parenthesized_expression", self.at)
        self.need("(")
        self.add(node, self.expression())
        self.need(")")
        return self.close(node)

    def _if(self, node: Node) -> Node:
        node.kind = "if_statement"
        self.next()
        self.add(node, self.condition(), "condition")
        self.add(node, self.statement(), "consequence")
        if self.is_("else"):
            other = Node("else_clause", self.at)
            self.next()
            self.add(node, self.close(self.add(other, self.statement())), "alternative")
        return node

    def _for(self, node: Node) -> Node:
        self.next()
        self.eat("await")
        self.need("(")
        first = None
        if self.is_("var", "let", "const"):
            first = self._var(Node("", self.at), False)
        if first is None and not self.is_(";"):
            first = self.expression(True)
        if self.is_("of", "in"):
            node.kind = "for_in_statement"
            if not first.kind.endswith("_declaration"):
                first = self.target(first)
            self.add(node, first, "left")
            of = self.next() == "of"
            self.add(node, self.assignment() if of else self.expression(), "right")
        else:
            node.kind = "for_statement"
            self.add(node, first, "initializer")
            self.need(";")
            if not self.is_(";"):
                self.add(node, self.expression(), "condition")
            self.need(";")
            if not self.is_(")"):
                self.add(node, self.expression(), "increment")
        self.need(")")
        return self.add(node, self.statement(), "body")

    def _while(self, node: Node) -> Node:
        node.kind = "with_statement" if self.next() == "with" else "while_statement"
        self.add(node, self.condition(), "condition")
        return self.add(node, self.statement(), "body")

    _with = _while

    def _do(self, node: Node) -> Node:
        node.kind = "do_statement"
        self.next()
        self.add(node, self.statement(), "body")
        self.need("while")
        self.add(node, self.condition(), "condition")
        self.eat(";")
        return node

    def _return(self, node: Node) -> Node:
        node.kind = f"{self.next()}_statement"
        if not (self.gap or self.type == "end" or self.is_("}", ";")):
            self.add(node, self.expression())
        self.semicolon()
        return node

    _throw = _return

    def _break(self, node: Node) -> Node:
        node.kind = f"{self.next()}_statement"
        if self.type == "name" and not self.gap and node.kind != "debugger_statement":
            self.add(node, self.leaf("statement_identifier"), "label")
        self.semicolon()
        return node

    _continue = _debugger = _break

    def _try(self, node: Node) -> Node:
        node.kind = "try_statement"
        self.next()
        self.add(node, self.block(), "body")
        if self.is_("catch"):
            part = Node("catch_clause", self.at)
            self.next()
            if self.eat("("):
                self.add(part, self.pattern(), "parameter")
                self.need(")")
            self.add(node, self.close(self.add(part, self.block(), "body")), "handler")
        if self.is_("finally"):
            part = Node("finally_clause", self.at)
            self.next()
            self.add(node, self.close(self.add(part, self.block(), "body")), "finalizer")
        return node

    def _switch(self, node: Node) -> Node:
        node.kind = "switch_statement"
        self.next()
        self.add(node, self.condition(), "value")
        body = Node("switch_body", self.at)
        self.need("{")
        while not self.is_("}"):
            part = Node(f"switch_{self.text}", self.at)
            if part.kind == "switch_case":
                self.next()
                self.add(part, self.expression(), "value")
            else:
                self.need("default")
            self.need(":")
            self.body(part, "}")
            self.add(body, self.close(part))
        self.need("}")
        return self.add(node, self.close(body), "body")

    def _import(self, node: Node) -> Node | None:
        if self.peek()[1] in ("(", "."):
            return None
        node.kind = "import_statement"
        self.next()
        if self.type == "name":
            self.add(node, self.leaf("identifier"), "name")
            self.eat(",")
        if self.eat("*"):
            self.need("as")
            self.add(node, self.leaf("identifier"), "name")
        elif self.is_("{"):
            self.specifiers(node, "import_specifier")
        self.eat("from")
        if self.type != "string":
            raise Wrong
        self.add(node, self.leaf("string"), "source")
        self.semicolon()
        return node

    def specifiers(self, node: Node, kind: str) -> None:
        self.need("{")
        while not self.is_("}"):
            one = Node(kind, self.at)
            first = self.leaf("identifier" if self.type == "name" else "string")
            if self.eat("as"):
                first.kind = "property_identifier" if kind == "import_specifier" else first.kind
                self.add(one, first, "name")
                self.add(one, self.leaf("identifier" if kind == "import_specifier" else "property_identifier"), "alias")
            else:
                self.add(one, first, "name")
            self.add(node, self.close(one))
            if not self.eat(","):
                break
        self.need("}")

    def _export(self, node: Node) -> Node:
        node.kind = "export_statement"
        self.next()
        if self.eat("default"):
            if self.is_("function", "class") or (self.is_("async") and self.peek()[1] == "function"):
                return self.add(node, self.class_("class_declaration") if self.is_("class") else self.function("function_declaration"), "value")
            self.add(node, self.assignment(), "value")
            self.semicolon()
        elif self.is_("*", "{"):
            if self.eat("*"):
                if self.eat("as"):
                    self.add(node, self.leaf("property_identifier"))
            else:
                self.specifiers(node, "export_specifier")
            if self.eat("from"):
                self.add(node, self.leaf("string"), "source")
            self.semicolon()
        else:
            self.add(node, self.statement(), "declaration")
        return node

    # --- functions and classes --------------------------------------------------------------------------------------------
    def function(self, kind: str) -> Node:
        node = Node(kind, self.at)
        self.eat("async")
        self.need("function")
        if self.eat("*"):
            node.kind = f"generator_{kind}" if kind == "function_declaration" else "generator_function"
        if self.type == "name":
            self.add(node, self.leaf("identifier"), "name")
        return self.rest(node)

    def rest(self, node: Node) -> Node:
        self.add(node, self.parameters(), "parameters")
        return self.close(self.add(node, self.block(), "body"))

    def parameters(self) -> Node:
        node = Node("formal_parameters", self.at)
        self.need("(")
        while not self.is_(")"):
            self.add(node, self.pattern(True))
            if not self.eat(","):
                break
        self.need(")")
        return self.close(node)

    def pattern(self, default: bool = False) -> Node:
        if self.is_("..."):
            node = Node("rest_pattern", self.at)
            self.next()
            return self.close(self.add(node, self.pattern()))
        if self.is_("[", "{"):
            found = self.target(self.primary())
        elif self.type == "name" and self.text not in _RESERVED:
            found = self.leaf("identifier")
        else:
            raise Wrong
        if default and self.eat("="):
            return self.over("assignment_pattern", ("left", found), ("right", self.assignment()))
        return found

    def target(self, node: Node) -> Node:
        """An expression as what is assigned to."""
        if node.kind in ("object", "array"):
            node.kind += "_pattern"
            node.below = [(f, self.target(b)) for f, b in node.below]
        elif node.kind == "pair":
            node.kind = "pair_pattern"
            node.below = [(f, self.target(b) if f == "value" else b) for f, b in node.below]
        elif node.kind == "assignment_expression" and node.value == "=":
            node.kind, node.value = "assignment_pattern", None
            node.below[0] = ("left", self.target(node.below[0][1]))
        elif node.kind == "spread_element":
            node.kind = "rest_pattern"
            node.below = [(f, self.target(b)) for f, b in node.below]
        elif node.kind == "shorthand_property_identifier":
            node.kind += "_pattern"
        elif node.kind not in ("identifier", "member_expression", "subscript_expression", "parenthesized_expression", "assignment_pattern"):
            if not node.kind.endswith(("_pattern", "property_identifier")):
                raise Wrong
        return node

    def class_(self, kind: str) -> Node:
        node = Node(kind, self.at)
        while self.eat("@"):
            self.add(node, self.calls(), "decorator")
        self.need("class")
        if self.type == "name" and not self.is_("extends"):
            self.add(node, self.leaf("identifier"), "name")
        if self.eat("extends"):
            self.add(node, self.calls(), "heritage")
        body = Node("class_body", self.at)
        self.need("{")
        while not self.is_("}"):
            if not self.eat(";"):
                self.add(body, self.member(True))
        self.need("}")
        return self.close(self.add(node, self.close(body), "body"))

    def key(self) -> Node:
        if self.is_("["):
            node = Node("computed_property_name", self.at)
            self.next()
            self.add(node, self.assignment())
            self.need("]")
            return self.close(node)
        if self.type not in ("name", "string", "number"):
            raise Wrong
        return self.leaf({"name": "private_property_identifier" if self.text[0] == "#" else "property_identifier"}.get(self.type, self.type))

    def member(self, of_class: bool) -> Node:
        """A member of a class, or one of an object literal."""
        node, plain = Node("method_definition", self.at), not of_class
        while of_class and self.eat("@"):
            self.add(node, self.calls(), "decorator")
        while self.type == "name" and self.text in ("static", "async", "get", "set"):
            word = self.peek()
            if word[1] in ("(", ",", "}", ":", "=", ";") or word[0] == "end" or (word[2] and self.text == "async"):
                if not (self.text == "static" and word[1] == "{"):
                    break
            if word[1] == "{":
                node.kind = "class_static_block"
                self.next()
                return self.close(self.add(node, self.block(), "body"))
            self.next()
            plain = False
        if self.eat("*"):
            plain = False
        name_type, first = self.type, self.at
        name = self.key()
        if self.is_("("):
            self.add(node, name, "name")
            return self.rest(node)
        if of_class:
            node.kind = "field_definition"
            self.add(node, name, "property")
            if self.eat("="):
                self.add(node, self.assignment(), "value")
            self.semicolon()
            return self.close(node)
        if not plain:
            raise Wrong
        if self.eat(":"):
            return self.over("pair", ("key", name), ("value", self.assignment()))
        if name_type != "name" or name.value in _RESERVED:
            raise Wrong
        name.kind = "shorthand_property_identifier"
        if self.eat("="):
            name.first = first
            name.kind += "_pattern"
            return self.over("assignment_pattern", ("left", name), ("right", self.assignment()))
        return name

    # --- expressions --------------------------------------------------------------------------------------------------------
    def expression(self, no_in: bool = False) -> Node:
        first = self.assignment(no_in)
        if not self.is_(","):
            return first
        every = [("", first)]
        while self.eat(","):
            every.append(("", self.assignment(no_in)))
        return self.over("sequence_expression", *every)

    def arrow(self, first: int, parameters: tuple[str, Node]) -> Node:
        node = Node("arrow_function", first)
        node.below.append(parameters)
        self.need("=>")
        return self.close(self.add(node, self.block() if self.is_("{") else self.assignment(), "body"))

    def assignment(self, no_in: bool = False) -> Node:
        at, word = self.at, self.peek() if self.type == "name" else None
        if word and word[1] == "=>" and self.text not in _RESERVED:
            return self.arrow(at, ("parameter", self.leaf("identifier")))
        if word and self.text == "async" and word[0] == "name" and not word[2] and word[1] not in ("function", "in", "of", "instanceof"):
            self.next()
            return self.arrow(at, ("parameter", self.leaf("identifier")))
        if self.is_("yield"):
            node = Node("yield_expression", at)
            self.next()
            if not (self.gap or self.type == "end" or self.is_(")", "]", "}", ",", ";", ":")):
                self.eat("*")
                self.add(node, self.assignment(no_in))
            return self.close(node)
        left = self.binary(0, no_in)
        if self.is_("=>") and not self.gap and left.kind == "formal_parameters":
            return self.arrow(at, ("parameters", left))
        if left.kind == "formal_parameters":
            raise Wrong
        if self.eat("?"):
            yes = self.assignment()
            self.need(":")
            return self.over("ternary_expression", ("condition", left), ("consequence", yes), ("alternative", self.assignment(no_in)))
        if self.type == "mark" and self.text in _ASSIGN:
            mark = self.next()
            if mark == "=":
                left = self.target(left)
            return self.over("assignment_expression" if mark == "=" else "augmented_assignment_expression", ("left", left), ("right", self.assignment(no_in)), value=mark)
        return left

    def binary(self, least: int, no_in: bool) -> Node:
        left = self.unary()
        while self.type in ("mark", "name") and self.text in _BINARY and not (no_in and self.text == "in"):
            strength = _BINARY[self.text]
            if strength < least or (strength == least and self.text != "**") or left.kind == "formal_parameters":
                break
            mark = self.next()
            left = self.over("binary_expression", ("left", left), ("right", self.binary(strength, no_in)), value=mark)
        return left

    def unary(self) -> Node:
        if self.is_("!", "~", "+", "-", "typeof", "void", "delete", "++", "--"):
            node = Node("update_expression" if self.text in ("++", "--") else "unary_expression", self.at, self.text)
            self.next()
            return self.close(self.add(node, self.unary(), "argument"))
        if self.is_("await"):
            word = self.peek()
            if not word[2] and (word[0] in ("name", "number", "string") and word[1] not in _BINARY or word[1] in ("(", "[", "{", "`", "!")):
                node = Node("await_expression", self.at)
                self.next()
                return self.close(self.add(node, self.unary()))
        node = self.calls()
        if self.is_("++", "--") and not self.gap:
            mark = self.next()
            return self.over("update_expression", ("argument", node), value=mark)
        return node

    def arguments(self) -> Node:
        node = Node("arguments", self.at)
        self.need("(")
        while not self.is_(")"):
            self.add(node, self.item())
            if not self.eat(","):
                break
        self.need(")")
        return self.close(node)

    def item(self) -> Node:
        if self.is_("..."):
            node = Node("spread_element", self.at)
            self.next()
            return self.close(self.add(node, self.assignment()))
        return self.assignment()

    def calls(self, called: bool = True) -> Node:
        if self.is_("new"):
            node = Node("new_expression", self.at)
            self.next()
            if self.eat("."):
                node.kind, node.value = "meta_property", "new.target"
                self.next()
                self.close(node)
            else:
                self.add(node, self.calls(False), "constructor")
                if self.is_("("):
                    self.add(node, self.arguments(), "arguments")
                self.close(node)
        else:
            node = self.primary()
        while True:
            if self.is_(".", "?."):
                chained = self.next() == "?."
                if chained and self.is_("("):
                    node = self.over("call_expression", ("function", node), ("arguments", self.arguments()))
                elif chained and self.is_("["):
                    node = self.index(node)
                elif self.type == "name":
                    node = self.over("member_expression", ("object", node), ("property", self.leaf("private_property_identifier" if self.text[0] == "#" else "property_identifier")))
                else:
                    raise Wrong
            elif self.is_("["):
                node = self.index(node)
            elif self.is_("`"):
                node = self.over("call_expression", ("function", node), ("arguments", self.template()))
            elif self.is_("(") and called and node.kind != "formal_parameters":
                async_ = node.kind == "identifier" and node.value == "async" and not self.gap
                given = self.arguments()
                if async_ and self.is_("=>"):
                    given.kind = "formal_parameters"
                    given.below = [(f, self.target(b)) for f, b in given.below]
                    return given
                node = self.over("call_expression", ("function", node), ("arguments", given))
            else:
                return node

    def index(self, node: Node) -> Node:
        self.need("[")
        inner = self.expression()
        self.need("]")
        return self.over("subscript_expression", ("object", node), ("index", inner))

    def template(self) -> Node:
        node, at = Node("template_string", self.at), self.at + 1
        while True:
            m = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S).match(self.code, at)
            at = m.end()
            if self.code.startswith("`", at):
                self.end = at + 1
                self.move(at + 1)
                return self.close(node)
            if not self.code.startswith("${", at):
                raise Wrong
            part = Node("template_substitution", at)
            self.move(at + 2)
            self.add(part, self.expression())
            if not self.is_("}"):
                raise Wrong
            at = part.upto = self.stop
            self.add(node, part)

    def primary(self) -> Node:
        if self.type in ("number", "string"):
            return self.leaf(self.type)
        if self.type == "name":
            if self.text == "function" or (self.text == "async" and self.peek()[1] == "function" and not self.peek()[2]):
                return self.function("function_expression")
            if self.text == "class":
                return self.class_("class")
            if self.text == "import":
                return self.leaf("import")
            if self.text in ("this", "super", "null", "true", "false"):
                return self.leaf(self.text)
            if self.text in _RESERVED:
                raise Wrong
            return self.leaf("private_property_identifier" if self.text[0] == "#" else "identifier")
        if self.type != "mark":
            raise Wrong
        if self.text == "(":
            return self.parenthesis()
        if self.text == "[":
            node = Node("array", self.at)
            self.next()
            while not self.is_("]"):
                if not self.eat(","):
                    self.add(node, self.item())
                    if not self.is_("]"):
                        self.need(",")
            self.next()
            return self.close(node)
        if self.text == "{":
            node = Node("object", self.at)
            self.next()
            while not self.is_("}"):
                self.add(node, self.item() if self.is_("...") else self.member(False))
                if not self.eat(","):
                    break
            self.need("}")
            return self.close(node)
        if self.text == "`":
            return self.template()
        if self.text in ("/", "/="):
            m = _REGEX.match(self.code, self.at)
            if m:
                node = Node("regex", self.at, m[0])
                self.end = m.end()
                self.move(m.end())
                return self.close(node)
        raise Wrong

    def parenthesis(self) -> Node:
        """An expression in parentheses, or the parameters of an arrow."""
        node, commas, spread = Node("parenthesized_expression", self.at), 0, False
        self.need("(")
        every: list[Node] = []
        while not self.is_(")"):
            spread = spread or self.is_("...")
            every.append(self.item())
            commas += self.is_(",")
            if not self.eat(","):
                break
        self.need(")")
        if self.is_("=>") and not self.gap:
            node.kind = "formal_parameters"
            node.below = [("", self.target(x)) for x in every]
            return self.close(node)
        if spread or not every or commas == len(every):
            raise Wrong
        if len(every) > 1:
            inner = Node("sequence_expression", every[0].first)
            inner.below = [("", x) for x in every]
            inner.upto = every[-1].upto
            every = [inner]
        return self.close(self.add(node, every[0]))


#: What a ``var`` or a function's parameters belong to, and what a ``let`` does.
_WHOLE = ("program", "class_static_block", *FUNCTION_KINDS)
_BLOCKS = (*_WHOLE, "statement_block", "for_statement", "for_in_statement", "catch_clause", "switch_body", "class_declaration", "class")
_NAMES = ("identifier", "shorthand_property_identifier", "shorthand_property_identifier_pattern")
#: What a name is in a field of a node.
_ROLES = {
    ("formal_parameters", ""): "parameter", ("arrow_function", "parameter"): "parameter", ("catch_clause", "parameter"): "catch", ("function_declaration", "name"): "function",
    ("generator_function_declaration", "name"): "function", ("function_expression", "name"): "self", ("generator_function", "name"): "self", ("class_declaration", "name"): "class",
    ("class", "name"): "self", ("import_statement", "name"): "import", ("import_specifier", "alias"): "import", ("import_specifier", "name"): "import",
    ("assignment_expression", "left"): "assign", ("augmented_assignment_expression", "left"): "assign", ("update_expression", "argument"): "assign", ("for_in_statement", "left"): "assign",
}


def _role(node: Node, field: str, role: str) -> str:
    """What names in a field are: definitions of a kind, assigned, or neither; patterns hand theirs on."""
    if node.kind == "variable_declarator":
        return node.value if field == "name" else ""
    if node.kind in ("object_pattern", "array_pattern", "rest_pattern") or (node.kind, field) in (("pair_pattern", "value"), ("assignment_pattern", "left")):
        return role
    return _ROLES.get((node.kind, field), "")


def tree(code: str) -> list[tuple]:
    """The rows of a script's tree, without its keys. ``scope_last`` is the last node of ``scope``, ``up`` the parent's kind, ``inside``
    the nearest function around."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    parser = Parser(code)
    root = parser.program()
    for note in parser.comments:
        at = root
        while True:
            i = bisect_right([b.first for _, b in at.below], note.first) - 1
            if i < 0 or at.below[i][1].upto < note.upto or at.below[i][1].kind == "comment":
                break
            at = at.below[i][1]
        if at.kind != "comment":
            at.below.insert(i + 1, ("", note))
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda at: bisect_right(starts, at)
    rows: list[list] = []
    # A node with its field, parent, depth, role, the nearest scopes around it (of functions, and of blocks too), parent's kind and function.
    stack: list[tuple] = [(root, "", -1, 0, "", 0, 0, None, None)]
    while stack:
        node, field, parent, depth, role, whole, block, up, inside = stack.pop()
        number = len(rows)
        scope = None if role in ("", "assign") else whole if role in ("var", "parameter") else block
        last = line(max(node.first, node.upto - 1))
        rows.append([number, number, parent, depth, node.kind, field, node.first, node.upto, line(node.first), last, node.value, role, scope, None, up, inside])
        inner = number if node.kind in _BLOCKS else block
        around = number if node.kind in _WHOLE else whole
        function = number if node.kind in FUNCTION_KINDS else inside
        # The name of a declaration belongs to what is around it, that of an expression to itself.
        stack += [(b, f, number, depth + 1, r := _role(node, f, role), around, block if r in ("function", "class") else inner, node.kind, function) for f, b in reversed(node.below)]
    for row in reversed(rows):
        if row[2] >= 0:
            rows[row[2]][1] = max(rows[row[2]][1], row[1])
    for row in rows:
        if row[12] is not None:
            row[13] = rows[row[12]][1]
    return [tuple(r) for r in rows]


def syntax(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The rows of all scripts' trees; a null text has none, an empty one its program alone. Scripts are dealt by key and parsed there."""
    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys)
    names = [x.split()[0] for x in NODES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for *key, code in batch[[*keys, text]].itertuples(index=False):
                rows += [(*key, *row) for row in tree(code)] if code is not None else []
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=[*keys, *names])
                    rows = []
        yield pd.DataFrame(rows, columns=[*keys, *names])

    return _dealt(files.select(*keys, text), *keys).mapInPandas(run, f"{kinds}, {NODES}")


def _text(text: str | Column, first: str = "first", upto: str = "upto") -> Column:
    return F.substring(text, F.col(first) + 1, F.col(upto) - F.col(first))


def _wide(rows: DataFrame) -> DataFrame:
    """Rows that no join may broadcast. A few bytes of a file become a script and that a tree, so Spark's estimates, made from
    the file, are far too small, and the driver would gather all of it."""
    return rows.hint("merge")


#: Children that a function is told by, and those that name what it is given to, by the kind of what holds both.
_PARTS, _HEADS, _HOLDERS = ("name", "parameters", "parameter"), ("left", "name", "key", "property"), ("assignment_expression", "variable_declarator", "pair", "field_definition")


def functions(files: DataFrame, keys: list[str], text: str, nodes: DataFrame) -> DataFrame:
    """start_line, end_line, name, params, ret, body, node and ``place`` of each function of the scripts, places counted from the innermost
    out, as a walk that visits children first meets them; of functions with equal lines the last one is left.

    A function is called by its own name; an expression by what it is assigned to, else the variable or key it is given to; without any of
    these its name is empty. params is the text between the parentheses, ret that of the last return that is no inner function's.

    The tree is read once: functions, what they are told by and what they return are dealt by key once, and grouped there by function.
    """
    c = F.col
    is_function = c("kind").isin(*FUNCTION_KINDS)
    is_part = c("field").isin(*_PARTS) & c("up").isin(*FUNCTION_KINDS)
    is_head = c("field").isin(*_HEADS) & c("up").isin(*_HOLDERS) & ~c("kind").isin("object_pattern", "array_pattern")
    is_back = (c("up") == "return_statement") & (c("field") == "") & (c("kind") != "comment") & c("inside").isNotNull()
    columns = ("node", "parent", "kind", "field", "first", "upto", "first_line", "last_line", "last", "up", "inside")
    told = nodes.where(is_function | is_part | is_head | is_back).select(*keys, *columns).repartition(*keys)
    span = F.struct("first", "upto")
    told = told.withColumn("head", F.max(F.when(is_head, span)).over(W.partitionBy(*keys, "parent")))
    # A node may be a function and what another one returns.
    of = lambda rule, what, at: F.when(rule, F.struct(F.lit(what).alias("what"), c(at).alias("at")))
    each = told.withColumn("x", F.explode(F.array_compact(F.array(of(is_function, "function", "node"), of(is_part, "part", "parent"), of(is_back, "back", "inside")))))
    own = lambda *of_it: F.max(F.when(c("x.what") == "function", F.struct(*of_it)))
    part = lambda *fields: F.max(F.when((c("x.what") == "part") & c("field").isin(*fields), F.struct("first", "upto", "kind")))
    found = each.groupBy(*keys, c("x.at").alias("node")).agg(
        own("kind", "field", "first", "upto", "first_line", "last_line", "last", "head").alias("f"), part("name").alias("name"), part("parameters", "parameter").alias("parameters"),
        F.max(F.when(c("x.what") == "back", F.struct("parent", "first", "upto"))).alias("back"),
    )
    whole = _wide(found.where("f IS NOT NULL").select(*keys, "node", "f.*", "name", "parameters", "back")).join(_wide(files.select(*keys, c(text).alias("code"))), keys)
    cut = lambda at: F.substring("code", c(f"{at}.first") + 1, c(f"{at}.upto") - c(f"{at}.first"))
    named = c("kind").isin("function_declaration", "generator_function_declaration", "method_definition")
    name = F.coalesce(F.when(named, cut("name")), F.when(c("field").isin("right", "value"), cut("head")), cut("name"), F.lit(""))
    given = cut("parameters")
    params = F.coalesce(F.when(c("parameters.kind") == "formal_parameters", F.substring(given, F.lit(2), F.char_length(given) - 2)).otherwise(given), F.lit(""))
    rows = whole.select(*keys, c("first_line").alias("start_line"), c("last_line").alias("end_line"), name.alias("name"), F.trim(F.regexp_replace(params, r"\s+", " ")).alias("params"), F.coalesce(cut("back"), F.lit("")).alias("ret"), _text("code").alias("body"), "node", "last")
    kept = rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys, "start_line", "end_line").orderBy(F.desc("last"), "node"))).where("__n = 1").drop("__n")
    return kept.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("last", F.desc("node")))).drop("last")


def statements_around(places: DataFrame, files: DataFrame, keys: list[str], text: str, nodes: DataFrame, line: str = "line_no") -> DataFrame:
    """first_line, last_line and text of the smallest statement, declaration or comment that a line (keys, line) lies in and that holds the
    line's text: the deepest node, of equally deep ones the shortest. Blank lines have no row."""
    code = files.select(*keys, F.col(text).alias("code"))
    value = F.trim(F.regexp_replace(F.element_at(F.split("code", "\n"), F.col(line).cast("int")), r"^\s+|\s+$", ""))
    asked = places.select(*keys, line).distinct().join(_wide(code), keys).where(F.col(line) <= F.size(F.split("code", "\n"))).withColumn("value", value).where("value <> ''")
    wide = nodes.where("kind LIKE '%statement%' OR kind LIKE '%declaration%' OR kind = 'comment'").select(*keys, "node", "depth", "first", "upto", "first_line", "last_line")
    hit = _wide(asked).join(_wide(wide), keys).where((F.col(line) >= F.col("first_line")) & (F.col(line) <= F.col("last_line"))).withColumn("text", _text("code")).where(F.contains("text", "value"))
    best = hit.groupBy(*keys, line).agg(F.max(F.struct("depth", (F.col("first") - F.col("upto")).alias("short"), (-F.col("node")).alias("early"), "first_line", "last_line", "text")).alias("x"))
    return best.select(*keys, line, F.col("x.first_line").alias("first"), F.col("x.last_line").alias("last"), "x.text")


def names(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each name in a script: keys, node, name, line_no, role, and ``binding``, the number of the scope that holds the name's
    definition (null for names of the surroundings). role is what defines the name there (var, let, const, parameter, catch, function,
    class, self, import), ``assign``, or empty where it is used.

    Variables of ``var`` and functions' parameters belong to the function around them, functions to the block they stand in, ``let``, ``const``
    and classes to the block around them, what is caught to its clause, names of function and class expressions to these. A name means the
    definition of the innermost scope that has one, wherever in the scope it stands. An assignment to a name that no scope defines
    defines it for the surroundings.
    """
    c = F.col
    every = nodes.where(c("kind").isin(*_NAMES)).select(*keys, "node", c("value").alias("name"), c("first_line").alias("line_no"), "role", "scope", "scope_last").repartition(*keys)
    is_given = ~c("role").isin("", "assign")
    # A name meets the definitions of its own name only.
    held = F.collect_set(F.when(is_given, F.struct("scope", "scope_last"))).over(W.partitionBy(*keys, "name"))
    inner = F.array_max(F.transform(F.filter(held, lambda x: c("node").between(x["scope"], x["scope_last"])), lambda x: x["scope"]))
    binding = F.when(is_given, c("scope")).when(c("role") == "assign", F.coalesce(inner, F.lit(0))).otherwise(inner)
    return every.select(*keys, "node", "name", "line_no", "role", binding.alias("binding"))


def names_in_ranges(ranges: DataFrame, found: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """For ranges of lines (keys, ids, first, last): def, the names that they define or assign, and use, the names whose definition lies
    elsewhere, each once in order; def_bindings and use_bindings have the scopes (-1 for the surroundings), so that equal names of
    different scopes are told apart. ``found`` is what ``names`` gives. Ranges without names have empty arrays."""
    inside = _wide(ranges.select(*keys, *ids, "first", "last")).join(_wide(found), keys).where(F.col("line_no").between(F.col("first"), F.col("last")))
    one = inside.groupBy(*keys, *ids, "name", F.coalesce("binding", F.lit(-1)).alias("binding")).agg(F.min("node").alias("node"), F.bool_or(F.col("role") != "").alias("defines"))
    sorted_ = lambda rule: F.array_sort(F.collect_list(F.when(rule, F.struct("node", "name", "binding"))))
    each = one.groupBy(*keys, *ids).agg(sorted_(F.col("defines")).alias("d"), sorted_(~F.col("defines")).alias("u"))
    out = ranges.select(*keys, *ids).distinct().join(_wide(each), [*keys, *ids], "left")
    pick = lambda c, part, kind: F.coalesce(F.transform(c, lambda x: x[part]), F.array().cast(f"array<{kind}>"))
    return out.select(
        *keys, *ids, pick("d", "name", "string").alias("def"), pick("u", "name", "string").alias("use"), pick("d", "binding", "int").alias("def_bindings"), pick("u", "binding", "int").alias("use_bindings"),
    )
