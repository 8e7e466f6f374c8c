"""Structure of declared shell commands: fragments, statements, pipelines, invocations, words and redirects."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

# Fixed limits.
MOST_STATEMENTS, MOST_FRAGMENTS, DEEPEST = 512, 16, 4
#: Programs whose -c scripts are read inside commands, and those that a declared list of arguments may name.
SHELLS = ("sh", "bash", "zsh")
DECLARED_SHELLS = (*SHELLS, "dash", "ksh")
#: Wrappers before a program: options that take a value, and a pattern of the options that stand alone. Anything else that looks like an option is not known.
WRAPPERS: dict[str, tuple[set[str], str]] = {
    "nice": ({"-n", "--adjustment"}, r"-n.+|--adjustment=.*|-[0-9]+"),
    "timeout": ({"-s", "-k", "--signal", "--kill-after"}, r"--(signal|kill-after)=.*|--preserve-status|--foreground|-v|--verbose"),
    "env": ({"-u", "--unset", "-C", "--chdir"}, r"-|-i|--ignore-environment|-0|--null|-v|--debug|--(unset|chdir)=.*"),
    "nohup": (set(), r"(?!)"),
    "command": (set(), r"-p"),
}
_OPERATORS = ("&&", "||", "|&", ";;", "|", ";", "&", "\n", "(", ")", "{", "}")
_REDIRECTS = ("&>>", "<<<", "<<-", "&>", ">>", "<<", ">&", "<&", ">|", "<>", ">", "<")
#: Words that open and close compound commands; they are not programs.
_KEYWORDS = {"if", "then", "elif", "else", "fi", "for", "while", "until", "do", "done", "case", "esac", "in", "function", "!", "time", "select"}


@dataclass
class Word:
    text: str
    basis: str = "literal"  # or quoted, dynamic
    nested: list[str] = field(default_factory=list)

    def as_value(self) -> dict[str, str]:
        return {"text": self.text, "basis": self.basis}


class _Broken(Exception):
    pass


class _Lexer:
    """Words, operators and redirects of a script; here-documents are read at the next line end."""

    def __init__(self, text: str):
        self.text, self.at, self.waiting = text, 0, []

    def tokens(self):
        text = self.text
        while self.at < len(text):
            c = text[self.at]
            if c in " \t\r" or text.startswith("\\\n", self.at):
                self.at += 2 if c == "\\" else 1
            elif c == "#":
                end = text.find("\n", self.at)
                self.at = len(text) if end < 0 else end
            elif redirect := self.redirect():
                yield redirect
            elif operator := next((o for o in _OPERATORS if text.startswith(o, self.at) and not (o in "{}" and text[self.at + 1 : self.at + 2].strip(" \t\n;") != "" and o == "{")), None):
                if operator == "}" and text[self.at + 1 : self.at + 2].strip(" \t\n;|&)") != "":
                    yield ("word", self.word())
                    continue
                self.at += len(operator)
                yield ("operator", operator)
                if operator == "\n":
                    self.skip_documents()
            else:
                yield ("word", self.word())

    def redirect(self):
        start = self.at
        digits = start
        while digits < len(self.text) and self.text[digits].isdigit():
            digits += 1
        operator = next((o for o in _REDIRECTS if self.text.startswith(o, digits)), None)
        if operator is None or self.text.startswith(("<(", ">("), digits):
            return None
        self.at = digits + len(operator)
        while self.text[self.at : self.at + 1] in (" ", "\t"):
            self.at += 1
        target = self.word() if self.at < len(self.text) and self.text[self.at] not in "\n;|&" else Word("")
        if operator in ("<<", "<<-"):
            self.waiting.append((target.text, operator == "<<-"))
        return ("redirect", (int(self.text[start:digits]) if digits > start else None, operator, target))

    def skip_documents(self) -> None:
        for delimiter, tabs in self.waiting:
            while True:
                end = self.text.find("\n", self.at)
                line = self.text[self.at : len(self.text) if end < 0 else end]
                self.at = len(self.text) if end < 0 else end + 1
                if (line.lstrip("\t") if tabs else line) == delimiter or end < 0:
                    break
        self.waiting.clear()

    def balanced(self, opening: str, closing: str) -> str:
        """The text between brackets from here on, and moves behind."""
        start, depth, i = self.at, 1, self.at
        while i < len(self.text) and depth:
            c = self.text[i]
            if c == "\\":
                i += 1
            elif c == "'" and opening == "(":
                i = self.text.find("'", i + 1)
                if i < 0:
                    raise _Broken
            elif c == opening:
                depth += 1
            elif c == closing:
                depth -= 1
            i += 1
        if depth:
            raise _Broken
        self.at = i
        return self.text[start : i - 1]

    def word(self) -> Word:
        out, quoted, dynamic, nested, text = [], False, False, [], self.text

        def expansion() -> None:
            nonlocal dynamic
            dynamic = True
            start = self.at
            if text.startswith("$(", self.at) and not text.startswith("$((", self.at):
                self.at += 2
                nested.append(self.balanced("(", ")"))
            elif text.startswith("${", self.at):
                self.at += 2
                self.balanced("{", "}")
            elif text.startswith("$((", self.at):
                self.at += 2
                self.balanced("(", ")")
            else:
                self.at += 1
                while self.at < len(text) and (text[self.at].isalnum() or text[self.at] == "_"):
                    self.at += 1
                if self.at == start + 1 and text[self.at : self.at + 1] in tuple("?!#@*$-") and self.at < len(text):
                    self.at += 1
            out.append(text[start : self.at])

        while self.at < len(text):
            c = text[self.at]
            if c in " \t\r\n;|&<>()" and not text.startswith(("<(", ">("), self.at):
                break
            if c == "'":
                end = text.find("'", self.at + 1)
                if end < 0:
                    raise _Broken
                quoted = True
                out.append(text[self.at + 1 : end])
                self.at = end + 1
            elif c == '"':
                quoted = True
                self.at += 1
                while True:
                    if self.at >= len(text):
                        raise _Broken
                    d = text[self.at]
                    if d == '"':
                        self.at += 1
                        break
                    if d == "\\" and text[self.at + 1 : self.at + 2] in tuple('"\\$`\n'):
                        out.append(text[self.at + 1 : self.at + 2].replace("\n", ""))
                        self.at += 2
                    elif d == "$":
                        expansion()
                    elif d == "`":
                        self.backticks(out, nested)
                        dynamic = True
                    else:
                        out.append(d)
                        self.at += 1
            elif c == "\\":
                out.append(text[self.at + 1 : self.at + 2])
                self.at += 2
            elif c == "$" and self.at + 1 < len(text) and (text[self.at + 1].isalnum() or text[self.at + 1] in "_({?!#@*$-"):
                expansion()
            elif c == "`":
                self.backticks(out, nested)
                dynamic = True
            elif text.startswith(("<(", ">("), self.at):
                dynamic = True
                start = self.at
                self.at += 2
                nested.append(self.balanced("(", ")"))
                out.append(text[start : self.at])
            else:
                dynamic |= c in "*?[" or (c == "~" and not out)
                out.append(c)
                self.at += 1
        return Word("".join(out), "dynamic" if dynamic else "quoted" if quoted else "literal", nested)

    def backticks(self, out: list[str], nested: list[str]) -> None:
        end = self.text.find("`", self.at + 1)
        if end < 0:
            raise _Broken
        nested.append(self.text[self.at + 1 : end])
        out.append(self.text[self.at : end + 1])
        self.at = end + 1


def _assignment(word: Word) -> bool:
    name, found, _ = word.text.partition("=")
    return bool(found) and name.rstrip("+").isidentifier()


def unwrap(words: list[Word]) -> list[list[Word]]:
    """The invocations in a command: itself, and the programs behind wrappers.

    An option that isn't known may take a value, and a dynamic word may be an option, so what follows them is left alone.
    """
    out = []
    while words:
        out.append(words)
        name = words[0].text.rpartition("/")[2]
        start = _behind(name, words) if name in WRAPPERS and words[0].basis != "dynamic" else None
        words = words[start:] if start is not None else []
    return out


def _behind(name: str, words: list[Word]) -> int | None:
    """The place of the program behind a wrapper, or None where it can't be told."""
    valued, alone = WRAPPERS[name]
    i = 1
    while i < len(words):
        text = words[i].text
        if words[i].basis == "dynamic":
            return None
        if text == "--":
            i += 1
            break
        if text in valued:
            i += 2
        elif re.fullmatch(alone, text) or (name == "env" and not text.startswith("-") and _assignment(words[i])):
            i += 1
        elif text.startswith("-"):
            return None
        else:
            break
    return i + (name == "timeout")  # a duration comes before timeout's program


def nested_script(words: list[Word]) -> str | None:
    """The script of `sh -c script`: the first word behind the options, if one of them is -c; None where an option isn't known."""
    if not words or words[0].text.rpartition("/")[2] not in SHELLS:
        return None
    i, asked = 1, False
    while i < len(words) and words[i].basis != "dynamic":
        text = words[i].text
        if text == "--":
            i += 1
            break
        if text in ("-o", "+o"):
            i += 2
        elif text.startswith("--"):
            i += 1
        elif re.fullmatch("-[A-Za-z]+", text):
            asked |= "c" in text
            i += 1
        elif text.startswith("-") and text != "-":
            return None
        else:
            break
    if not asked or i >= len(words) or words[i].basis == "dynamic":
        return None
    return words[i].text if words[i].text.strip() else None


@dataclass
class _Build:
    fragments: list[dict[str, Any]] = field(default_factory=list)
    statements: int = 0


def _fragment(build: _Build, text: str, language: str, parent: dict[str, int] | None, depth: int) -> None:
    if len(build.fragments) >= MOST_FRAGMENTS or depth > DEEPEST:
        return
    own: dict[str, Any] = {"text": text, "language": language, "status": "complete", "statements": []}
    if parent:
        own["parent"] = parent
    number = len(build.fragments)
    build.fragments.append(own)
    if language not in (*DECLARED_SHELLS, "shell"):
        own["status"] = "partial"
        return
    inner: list[tuple[str, int]] = []
    words: list[Word] = []
    redirects: list[dict[str, Any]] = []
    assignments: list[dict[str, str]] = []
    connector, pipeline, position = "first", 0, 0

    def close() -> None:
        nonlocal words, redirects, assignments
        if not (words or redirects or assignments):
            return
        if build.statements >= MOST_STATEMENTS:
            own["status"] = "partial"
            words, redirects, assignments = [], [], []
            return
        statement: dict[str, Any] = {"id": len(own["statements"]), "pipeline": {"id": pipeline, "position": position}, "invocations": [], "redirects": redirects}
        if connector != "first":
            statement["connector"] = connector
        if assignments:
            statement["assignments"] = assignments
        for call in unwrap(words):
            program = call[0]
            entry: dict[str, Any] = {"program": program.as_value(), "arguments": [w.as_value() for w in call[1:]]}
            if program.basis != "dynamic":
                entry["name"] = program.text.rpartition("/")[2]
            statement["invocations"].append(entry)
        if (script := nested_script(unwrap(words)[-1] if words else [])) is not None:
            inner.append((script, statement["id"]))
        for w in words:
            inner.extend((n, statement["id"]) for n in w.nested)
        own["statements"].append(statement)
        build.statements += 1
        words, redirects, assignments = [], [], []

    depth_of_brackets = 0
    header = False  # the words after for, case, select and function name no program
    try:
        for kind, token in _Lexer(text).tokens():
            if kind == "redirect":
                descriptor, operator, target = token
                redirects.append({"operator": operator, "target": target.as_value()} | ({"descriptor": descriptor} if descriptor is not None else {}))
                inner.extend((n, len(own["statements"])) for n in target.nested)
            elif kind == "word":
                if not words and token.basis == "literal" and token.text in _KEYWORDS:
                    header = token.text in ("for", "case", "select", "function") or (header and token.text == "in")
                    continue
                if header:
                    inner.extend((n, len(own["statements"])) for n in token.nested)
                    continue
                if not words and _assignment(token):
                    assignments.append(token.as_value())
                    inner.extend((n, len(own["statements"])) for n in token.nested)
                else:
                    words.append(token)
            else:
                had = bool(words or redirects or assignments)
                header = False
                close()
                if token in ("(", "{"):
                    depth_of_brackets += 1
                elif token in (")", "}"):
                    depth_of_brackets -= 1
                    if depth_of_brackets < 0:
                        raise _Broken
                elif token in ("|", "|&"):
                    connector, position = "pipe", position + 1
                elif had or token in ("&&", "||"):
                    connector = {"&&": "and", "||": "or", "&": "background"}.get(token, "sequence")
                    pipeline, position = pipeline + 1, 0
        if depth_of_brackets:
            raise _Broken
        close()
    except _Broken:
        close()
        own["status"] = "partial"
    for script, statement in inner:
        _fragment(build, script, "sh", {"fragment": number, "statement": statement}, depth + 1)


def parse_shell(text: str, language: str = "bash") -> list[dict[str, Any]]:
    """Fragments of a command text: the text itself, then nested scripts, with a status of `complete` or `partial`.

    Unsupported languages and broken syntax give a partial fragment; limits on statements, fragments and depth hold.
    """
    build = _Build()
    _fragment(build, text, language, None, 1)
    return build.fragments


def declared_command(name: str | None, arguments: Any) -> tuple[str, str] | None:
    """(text, language) of a tool call that declares a shell command, by the shape of its arguments."""
    if not isinstance(arguments, dict):
        return None
    for member in ("command", "cmd", "script", "CommandLine"):
        given = arguments.get(member)
        if isinstance(given, str) and given.strip() and (name or "").lower() in ("bash", "shell", "shell_command", "exec_command", "local_shell", "run_command", "container.exec", "sh"):
            return given, "bash"
        if isinstance(given, list) and given and all(isinstance(x, str) for x in given):
            if given[0].rpartition("/")[2] in DECLARED_SHELLS and len(given) >= 3 and given[1] in ("-c", "-lc", "-cl"):
                return given[2], given[0].rpartition("/")[2]
            if (name or "").lower() in ("shell", "local_shell", "container.exec"):
                import shlex

                return shlex.join(given), "sh"
    return None
