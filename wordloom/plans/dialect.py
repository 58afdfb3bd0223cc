"""The few places where the engine's SQL and the oracle's differ."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def listagg(self, value: str, sep: str, order: str, where: str = "") -> str:
        """Ordered string aggregation; empty groups give the empty string."""
        keep = f" filter (where {where})" if where else ""
        if self.spark:
            return f"coalesce(listagg({value}, '{sep}') within group (order by {order}){keep}, '')"
        return f"coalesce(string_agg({value}, '{sep}' order by {order}){keep}, '')"

    def idiv(self, a: str, b: str) -> str:
        return f"cast(floor(({a}) / ({b})) as bigint)"

    def replace_all(self, value: str, pattern: str, to: str = "") -> str:
        """Regular expression replacement; group references are written \\1."""
        if self.spark:
            for k in "123":
                to = to.replace(f"\\{k}", f"${k}")
            return f"regexp_replace({value}, r'{pattern}', '{to}')"
        return f"regexp_replace({value}, '{pattern}', '{to}', 'g')"

    def matches(self, value: str, pattern: str) -> str:
        return f"regexp_like({value}, r'{pattern}')" if self.spark else f"regexp_matches({value}, '{pattern}')"

    def extract(self, value: str, pattern: str, group: int = 1) -> str:
        raw = "r" if self.spark else ""
        return f"regexp_extract({value}, {raw}'{pattern}', {group})"

    def tokens(self, source: str, key: str, text: str, pattern: str = " ") -> str:
        """(key, position from 1, word) of the non-empty pieces of a text."""
        if self.spark:
            return f"select {key}, cast(pos + 1 as bigint) as position, word from {source} lateral view posexplode(split({text}, r'{pattern}')) as pos, word where word <> ''"
        return (
            f"select {key}, position, word from (select {key}, unnest(w) as word, unnest(range(1, len(w) + 1)) as position "
            f"from (select {key}, regexp_split_to_array({text}, '{pattern}') as w from {source})) where word <> ''"
        )

    def each_int(self, lo: str, hi: str, name: str, source: str, keys: str) -> str:
        """A row per integer from lo to hi for each row of the source."""
        if self.spark:
            return f"select {keys}, {name} from {source} lateral view explode(sequence({lo}, {hi})) as {name} where {lo} <= {hi}"
        return f"select {keys}, unnest(range({lo}, {hi} + 1)) as {name} from {source} where {lo} <= {hi}"

    def text(self, value: str) -> str:
        return f"cast({value} as string)" if self.spark else f"cast({value} as varchar)"

    def seconds(self, ts: str) -> str:
        return f"unix_micros(cast({ts} as timestamp))" if self.spark else f"epoch_us({ts})"

    def arg_max(self, value: str, by: str) -> str:
        return f"max_by({value}, {by})" if self.spark else f"arg_max({value}, {by})"


SPARK, DUCKDB = Dialect(True), Dialect(False)
