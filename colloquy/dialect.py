"""The few expressions that Spark SQL and ANSI engines such as DuckDB write differently.

Plans are declared once, as a function of a dialect, and Spark's text is what runs here. The other text serves as an
independent oracle in tests.
"""

from __future__ import annotations

import sys
import unicodedata


def _bare() -> dict[str, str]:
    """Each lower-case letter that Unicode takes for another one with marks -> that one."""
    out = {}
    for c in map(chr, range(0xC0, min(0x20000, sys.maxunicode))):
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and c == c.lower() and unicodedata.category(d[0]) != "Mn" and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            out[c] = d[0]
    return out


BARE = _bare()
ACCENTED, PLAIN = "".join(BARE), "".join(BARE.values())


def folded(text: str) -> str:
    """``text`` in lower case without marks, as the plans' ``fold`` has it."""
    return "".join(c for c in text.lower().translate(str.maketrans(BARE)) if unicodedata.category(c) != "Mn")


class Spark:
    name = "spark"

    def find(self, text: str, pattern: str) -> str:
        """All matches of a pattern, an array."""
        return f"regexp_extract_all({text}, '{self._p(pattern)}', 0)"

    def group(self, text: str, pattern: str, n: int) -> str:
        return f"regexp_extract({text}, '{self._p(pattern)}', {n})"

    def sub(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{self._p(pattern)}', '{by}')"

    def matches(self, text: str, pattern: str) -> str:
        return f"({text} RLIKE '{self._p(pattern)}')"

    @staticmethod
    def _p(pattern: str) -> str:
        return pattern.replace("\\", "\\\\").replace("'", "\\'")

    def fold(self, text: str) -> str:
        """Lower case without marks, of any script: letters that come with marks in one character, and marks of their own."""
        return self.sub(f"translate(lower({text}), '{ACCENTED}', '{PLAIN}')", "\\p{Mn}+", "")

    def size(self, array: str) -> str:
        return f"cast(size({array}) AS BIGINT)"

    def unnest(self, relation: str, array: str, item: str, at: str | None = None) -> str:
        """A FROM item: each row of ``relation`` with each element, and its place from 0."""
        return f"{relation} LATERAL VIEW posexplode({array}) AS {at or '_at'}, {item}" if at else f"{relation} LATERAL VIEW explode({array}) AS {item}"

    def join(self, value: str, by: str, order: str) -> str:
        return f"listagg({value}, '{by}') WITHIN GROUP (ORDER BY {order})"

    def join_distinct(self, value: str, by: str) -> str:
        return f"array_join(array_sort(collect_set({value})), '{by}')"

    def mapped(self, array: str, var: str, body: str) -> str:
        return f"transform({array}, {var} -> {body})"

    def kept(self, array: str, var: str, body: str) -> str:
        return f"filter({array}, {var} -> {body})"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"array_union({a}, {b})"

    def series(self, a: str, b: str) -> str:
        """a to b; empty if b < a."""
        return f"(CASE WHEN {b} >= {a} THEN sequence(cast({a} AS BIGINT), cast({b} AS BIGINT)) ELSE cast(array() AS ARRAY<BIGINT>) END)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS DOUBLE) * cast(y AS DOUBLE)), cast(0 AS DOUBLE), (s, x) -> s + x)"

    def at(self, array: str, place: str) -> str:
        """The element at a place from 1."""
        return f"element_at({array}, cast({place} AS INT))"

    def cut(self, text: str, start: str, n: str) -> str:
        return f"substring({text}, {start}, {n})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def gather(self, value: str, order: str) -> str:
        """Values of a group as an array in the order of ``order``."""
        return f"transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), x -> x.v)"

    def ln(self, x: str) -> str:
        return f"ln({x})"

    def text(self, value: str) -> str:
        """A string literal."""
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def texts(self, values) -> str:
        return ", ".join(map(self.text, values))

    def starts(self, text: str, start: str) -> str:
        return f"startswith({text}, {start})"

    def some(self, array: str, var: str, body: str) -> str:
        """Whether an element satisfies ``body``."""
        return f"exists({array}, {var} -> {body})"

    def blend(self, a: str, b: str, wa: str, wb: str) -> str:
        """wa * a + wb * b of two arrays of numbers."""
        return f"zip_with({a}, {b}, (x, y) -> {wa} * cast(x AS DOUBLE) + {wb} * cast(y AS DOUBLE))"

    def canonical(self, text: str) -> str:
        """Lower case, letters and digits only, single spaces; other characters vanish without splitting a word."""
        bare = self.sub(f"lower({text})", "[^\\p{L}\\p{N} \t\n\r]", "")
        return f"trim({self.sub(bare, '[ \t\n\r]+', ' ')})"

    def trimmed(self, text: str) -> str:
        """Words between white space without punctuation at their ends."""
        return self.kept(self.mapped(self.find(text, "[^ \t\n\r]+"), "w", self.sub("w", "^\\p{P}+|\\p{P}+$", "")), "w", "w <> ''")

    def grams(self, text: str, n: int) -> str:
        """The different runs of n characters of a text: one match begins at each character, so time is linear."""
        return f"array_distinct(regexp_extract_all({text}, '(?s)(?=(.{{{n}}})).', 1))"

    def fit(self, array: str, n: int) -> str:
        """The first n elements, zeros where there are fewer; empty stays empty."""
        return f"CASE WHEN size({array}) = 0 THEN {array} ELSE slice(concat({array}, array_repeat(cast(0 AS DOUBLE), {n})), 1, {n}) END"


class Duck(Spark):
    name = "duckdb"

    def find(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, '{self._p(pattern)}')"

    def sub(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{self._p(pattern)}', '{by}', 'g')"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{self._p(pattern)}')"

    @staticmethod
    def _p(pattern: str) -> str:
        return pattern.replace("'", "''")

    def fold(self, text: str) -> str:
        return f"strip_accents(lower({text}))"

    def size(self, array: str) -> str:
        return f"len({array})"

    def unnest(self, relation: str, array: str, item: str, at: str | None = None) -> str:
        if at:
            return f"(SELECT *, unnest({array}) AS {item}, generate_subscripts({array}, 1) - 1 AS {at} FROM {relation})"
        return f"(SELECT *, unnest({array}) AS {item} FROM {relation})"

    def join(self, value: str, by: str, order: str) -> str:
        return f"string_agg({value}, '{by}' ORDER BY {order})"

    def join_distinct(self, value: str, by: str) -> str:
        return f"array_to_string(list_sort(list(DISTINCT {value}) FILTER (WHERE {value} IS NOT NULL)), '{by}')"

    def mapped(self, array: str, var: str, body: str) -> str:
        return f"list_transform({array}, lambda {var}: {body})"

    def kept(self, array: str, var: str, body: str) -> str:
        return f"list_filter({array}, lambda {var}: {body})"

    def distinct(self, array: str) -> str:
        return f"list_distinct({array})"

    def common(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"list_distinct(list_concat({a}, {b}))"

    def series(self, a: str, b: str) -> str:
        return f"generate_series(cast({a} AS BIGINT), cast({b} AS BIGINT))"

    def dot(self, a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: cast(z[1] AS DOUBLE) * cast(z[2] AS DOUBLE)))"

    def at(self, array: str, place: str) -> str:
        return f"({array})[cast({place} AS INT)]"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def gather(self, value: str, order: str) -> str:
        return f"list({value} ORDER BY {order})"

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def starts(self, text: str, start: str) -> str:
        return f"starts_with({text}, {start})"

    def some(self, array: str, var: str, body: str) -> str:
        return f"len(list_filter({array}, lambda {var}: {body})) > 0"

    def blend(self, a: str, b: str, wa: str, wb: str) -> str:
        return f"list_transform(list_zip({a}, {b}), lambda z: {wa} * cast(z[1] AS DOUBLE) + {wb} * cast(z[2] AS DOUBLE))"

    def grams(self, text: str, n: int) -> str:
        return f"list_distinct(list_transform({self.series('1', f'length({text}) - {n - 1}')}, lambda i: {text}[i:i + {n - 1}]))"

    def fit(self, array: str, n: int) -> str:
        return f"CASE WHEN len({array}) = 0 THEN {array} ELSE list_concat({array}, list_transform(generate_series(1, {n}), lambda i: cast(0 AS DOUBLE)))[1:{n}] END"


SPARK, DUCK = Spark(), Duck()
