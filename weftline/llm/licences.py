"""Licence statements found by template markup compiled into token automata.

A template is wording with two kinds of markup, as licence lists use:
``<<beginOptional>> ... <<endOptional>>`` (may nest) for wording that may be
left out, and ``<<var;name="..";original="..";match="..">>`` for wording that may be another.  ``match`` is ``.+`` or ``.*`` (any
words), ``.{a,b}`` (any words, as many as b at most, at least one if a is not 0; without a limit past 64), or literal
alternatives ``one|another``; without it only the original fits.  ``<<var;max=N>>`` is short for up to N words.  A template
compiles to an automaton over words; a text is accepted where the automaton
reaches its end, so all mandatory wording has to stand there exactly, in order
and with nothing in between.

Words are the runs of letters and digits of the text after lower-casing A-Z;
everything outside ASCII belongs to words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weftline.llm.bpe import _typed
from weftline.llm.common import map_text

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Templates by label.
TEMPLATES = {
    "mit-grant": "<<beginOptional>>copyright <<var;max=12>><<endOptional>> permission is hereby granted free of charge to any person obtaining a copy of this <<var;max=6>> and associated documentation files",
    "mit-notice": "<<beginOptional>>this <<var;max=3>> is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit <<beginOptional>>x11<<endOptional>> license",
    "apache-2-notice": "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>",
    "gpl-3": "<<beginOptional>>this <<var;max=3>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation <<beginOptional>>either<<endOptional>><<endOptional>> <<beginOptional>>version<<endOptional>> 3",
    "gpl-2": "<<beginOptional>>this <<var;max=3>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation <<beginOptional>>either<<endOptional>><<endOptional>> <<beginOptional>>version<<endOptional>> 2",
    "cc-by-nc-4": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by nc 4 0 <<beginOptional>>license<<endOptional>>",
    "cc-by-4": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by 4 0 <<beginOptional>>license<<endOptional>>",
    "bsd-clauses": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc-grant": "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted",
    "all-rights-reserved": "<<beginOptional>>copyright <<var;max=8>><<endOptional>> all rights reserved",
    "mit-text": """<<beginOptional>>MIT License<<endOptional>> <<beginOptional>>Copyright <<var;name="copyright";original="(c) year holder";match=".{0,40}">><<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of this <<var;name="work";original="software and associated documentation files";match="software and associated documentation files|software">> (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<var;name="infringement";original="NONINFRINGEMENT";match="noninfringement|non infringement">>. IN NO EVENT SHALL <<var;name="liable";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """<<beginOptional>>ISC License<<endOptional>> <<beginOptional>>Copyright <<var;name="copyright";original="(c) year holder";match=".{0,40}">><<endOptional>>
Permission to use, copy, modify, <<var;name="and";original="and/or";match="and|and or">> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";original="THE AUTHOR";match=".{1,40}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="liable";original="THE AUTHOR";match=".{1,40}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-text": """<<beginOptional>>Copyright <<var;name="copyright";original="(c) year holder";match=".{0,40}">><<endOptional>>
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<var;name="bullet1";original="1.";match=".{0,1}">> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<var;name="bullet2";original="2.";match=".{0,1}">> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
<<beginOptional>><<var;name="bullet3";original="3.";match=".{0,1}">> Neither the name of <<var;name="holder";original="the copyright holder";match=".+">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.<<endOptional>>
THIS SOFTWARE IS PROVIDED BY <<var;name="provider";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="liable";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".+">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}

_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARKUP = re.compile(r"<<(.*?)>>|([^<\s]+)")


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


@dataclass
class Automaton:
    """States are numbered along the template; ``step[s]`` leads on by word, ``free[s]`` by any word."""

    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    free: list[int | None] = field(default_factory=lambda: [None])
    skip: list[set[int]] = field(default_factory=lambda: [set()])
    mandatory: int = 0
    anchor: bytes = b""

    def add(self) -> int:
        self.step.append({})
        self.free.append(None)
        self.skip.append(set())
        return len(self.step) - 1

    def closure(self, states: set[int]) -> set[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def finish(self) -> Automaton:
        self.closures = [frozenset(self.closure({s})) for s in range(len(self.step))]
        self.firsts = {w for s in self.closures[0] for w in self.step[s]}
        self.any_first = any(self.free[s] is not None for s in self.closures[0])
        self.last = len(self.step) - 1
        return self

    def accepts(self, text: list[bytes], at: int) -> bool:
        """Whether the template's wording stands at word ``at``."""
        states = self.closures[0]
        while states:
            if self.last in states:
                return True
            if at == len(text):
                return False
            word, after = text[at], set()
            for s in states:
                if (to := self.step[s].get(word)) is not None:
                    after |= self.closures[to]
                if (to := self.free[s]) is not None:
                    after |= self.closures[to]
            states, at = after, at + 1
        return False


@dataclass
class Mark:
    """A piece of a template: wording, the begin or end of an optional part, or a variable of ``least`` to ``most`` words or of alternatives."""

    kind: str
    words: list[str] = field(default_factory=list)
    least: int = 0
    most: int | None = None
    options: list[list[str]] | None = None


#: A variable of more words than this has no limit.
LONGEST = 64


def _variable(text: str) -> Mark:
    given = {k: quoted or bare for k, quoted, bare in re.findall(r';(\w+)=(?:"([^"]*)"|([^;]*))', text)}
    plain = lambda x: [w.decode() for w in words(x)]
    if "max" in given:
        return Mark("var", most=int(given["max"]))
    match = given.get("match", given.get("original"))
    if match in (".+", ".*"):
        return Mark("var", least=int(match == ".+"))
    if (m := re.fullmatch(r"\.\{(\d+),(\d*)\}", match or "")) is not None:
        return Mark("var", least=min(int(m[1]), 1), most=int(m[2]) if m[2] and int(m[2]) <= LONGEST else None)
    literal = match is not None and ("match" not in given or not re.search(r"[\\\[\]{}*+?^$.()]", match))
    if not literal:
        raise ValueError(f"unknown markup {text!r}")
    return Mark("var", options=[plain(x) for x in (match.split("|") if "match" in given else [match])])


def marks(template: str) -> list[Mark]:
    out, depth = [], 0
    for m in _MARKUP.finditer(template):
        mark, word = m.groups()
        if word is not None:
            out.append(Mark("word", [w.decode() for w in words(word)]))
        elif (name := mark.partition(";")[0]) in ("beginOptional", "endOptional"):
            depth += 1 if name == "beginOptional" else -1
            out.append(Mark(name))
        elif name == "var":
            out.append(_variable(mark))
        else:
            raise ValueError(f"unknown markup {mark!r}")
        if depth < 0:
            break
    if depth or not any(m.kind == "word" and m.words for m in out):
        raise ValueError("a template closes its optional parts and has mandatory wording")
    return out


def compile_template(template: str) -> Automaton:
    a, opened, mandatory = Automaton(), [], []
    here = 0

    def chain(at: int, text: list[str]) -> int:
        for w in text:
            new = a.add()
            a.step[at][w.encode()] = new
            at = new
        return at

    for m in marks(template):
        if m.kind == "word":
            here = chain(here, m.words)
            if not opened:
                mandatory += [w.encode() for w in m.words]
        elif m.kind == "beginOptional":
            opened.append(here)
        elif m.kind == "endOptional":
            new = a.add()
            a.skip[here].add(new)
            a.skip[opened.pop()].add(new)
            here = new
        elif m.options is not None:
            ends = []
            for text in m.options:  # each begins in a state of its own, as they may begin alike
                first = a.add()
                a.skip[here].add(first)
                ends.append(chain(first, text))
            here = a.add()
            for s in ends:
                a.skip[s].add(here)
        else:
            begun = [here] if m.least == 0 else []
            for _ in range(max(m.least, m.most or 0)):
                new = a.add()
                a.free[here] = new
                here = new
                begun.append(new)
            new = a.add()
            for s in begun:
                a.skip[s].add(new)
            if m.most is None:
                a.free[new] = new
                here = a.add()
                a.skip[new].add(here)
            else:
                here = new
    if not mandatory:
        raise ValueError("a template closes its optional parts and has mandatory wording")
    a.mandatory, a.anchor = len(mandatory), max(mandatory, key=len)
    return a.finish()


def template_regex(template: str) -> str:
    """The same wording as a regular expression over the words joined by one space, with a space at both ends."""
    out = []
    for m in marks(template):
        if m.kind == "word":
            out += [f"{w} " for w in m.words]
        elif m.options is not None:
            out.append("(?:" + "|".join("".join(f"{w} " for w in text) for text in m.options) + ")")
        elif m.kind == "var":
            out.append("(?:[^ ]+ ){%d,%s}" % (m.least, "" if m.most is None else m.most))
        else:
            out.append({"beginOptional": "(?:", "endOptional": ")?"}[m.kind])
    return " " + "".join(out)


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.templates = [(label, compile_template(t)) for label, t in templates.items()]

    def scan(self, text: str | None) -> tuple:
        flat = (text or "").encode().translate(_TABLE)
        found = flat.split()
        starts, base, labels, longest = [], set(), set(), 0
        for phrase, label in self.phrases:
            if all(w in flat for w in phrase):
                at = [i for i in range(len(found) - len(phrase) + 1) if found[i] == phrase[0] and found[i : i + len(phrase)] == phrase]
                if at:
                    starts += at
                    base.add(label)
                    longest = max(longest, len(phrase))
        for label, a in self.templates:
            if a.anchor in flat and any((a.any_first or w in a.firsts) and a.accepts(found, i) for i, w in enumerate(found)):
                labels.add(label)
                longest = max(longest, a.mandatory)
        both = ",".join(sorted(base | labels))
        return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), both, longest / (longest + 1)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(df: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row, where base phrases stand and which labels its wording earns.

    ``score`` is n / (n + 1) for the n words of the longest mandatory wording that
    was found, and 0 where none was.  A null text counts as empty: no words, no
    labels (empty strings), null places.  Repeated rows are scanned each for
    itself; equal labels are listed once; an empty table gives an empty table.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates

    def make():
        scanner = Scanner(phrases, templates)
        return lambda i, text: (i, *scanner.scan(text))

    return map_text(df, id_col, text_col, f"{_typed(df, id_col)}, {SCHEMA}", make)


def scan_sql(phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL for :func:`scan` over ``documents``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    array = lambda p: "[" + ", ".join(f"'{w}'" for w in p.split()) + "]"
    places = " || ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i : i + {len(p.split()) - 1}] = {array(p)})" for p in phrases)
    base = ", ".join(f"CASE WHEN len(list_filter(range(1, len(w) + 1), lambda i: w[i : i + {len(p.split()) - 1}] = {array(p)})) > 0 THEN '{label}' END" for p, label in phrases.items())
    more = ", ".join(f"CASE WHEN regexp_matches(flat, '{template_regex(t)}') THEN '{label}' END" for label, t in templates.items())
    lengths = {label: len(p.split()) for p, label in phrases.items()} | {label: compile_template(t).mandatory for label, t in templates.items()}
    longest = ", ".join(f"CASE WHEN list_contains(every, '{label}') THEN {n} ELSE 0 END" for label, n in lengths.items())
    clean = lambda x: f"list_sort(list_distinct(list_filter([{x}], lambda v: v IS NOT NULL)))"
    return f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), flat AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS flat FROM split
), found AS (
  SELECT doc_id, w, {places} AS places, {clean(base)} AS own, {clean(base + ", " + more)} AS every FROM flat
), long AS (SELECT *, greatest({longest}) AS n FROM found)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  array_to_string(own, ',') AS base_labels, array_to_string(every, ',') AS labels,
  CAST(n AS DOUBLE) / CAST(n + 1 AS DOUBLE) AS score
FROM long
"""
