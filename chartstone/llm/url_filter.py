"""URL filters: a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And state vector. A glob over a canonical URL
(host + path) may hold ``?`` (one byte but '/'), ``*`` (any run without '/'), ``**`` (any run) and
``\\`` before a literal character. Each rule takes one bit a state, its first state and its last
included; a step over byte c is

    D = ((D << 1) & advance[c]) | (D & loop[c])

for all rules of all URLs of a batch at once, 64 states a machine word. URLs are stepped together by
position, longest first, so short URLs drop out of the front and memory is the bytes of the batch.

Defined results: a null url, or one without '://', has an empty host and path; no host rule fits
those, and the globs judge the empty string. Rules that tie in length: the first in the list wins. Repeated rows are judged
each by itself; an empty table gives no rows; a very long url is judged whole, at the cost of a step a byte;
only the id and url columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Host rules of the contract (host, path prefix, verdict).
HOST_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Globs of the method, for what no host rule fits; the longest that matches wins, none: allow.
GLOB_RULES = (
    ("**/wp-admin/**", "block"),
    ("**/cgi-bin/**", "block"),
    ("**/login**", "block"),
    ("**/signin**", "block"),
    ("**/signup**", "block"),
    ("**/cart/**", "block"),
    ("**/checkout/**", "block"),
    ("**/tag/*/feed/**", "block"),
    ("**.exe", "block"),
    ("**.zip", "block"),
    ("**.rss", "block"),
    ("ads.*/**", "block"),
    ("*.ads.*/**", "block"),
    ("tracker*.*/**", "block"),
    ("**/login/help.html", "allow"),
    ("*.edu/**", "allow"),
)


def parse_glob(glob: str) -> list[tuple[str, int]]:
    """('lit', byte), ('any', 0), ('run', 0) within a path segment, or ('all', 0)."""
    out: list[tuple[str, int]] = []
    data, i = glob.encode(), 0
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\" and i + 1 < len(data):
            out.append(("lit", data[i + 1]))
            i += 2
        elif data[i : i + 2] == b"**":
            out.append(("all", 0))
            i += 2
        elif c == b"*":
            out.append(("run", 0))
            i += 1
        elif c == b"?":
            out.append(("any", 0))
            i += 1
        else:
            out.append(("lit", data[i]))
            i += 1
    return out


def glob_to_regex(glob: str) -> str:
    """The same rule as an RE2 pattern, for the SQL oracle and tests."""
    parts = {"any": "[^/]", "run": "[^/]*", "all": ".*"}
    out = b"".join(re.escape(bytes([b])) if kind == "lit" else parts[kind].encode() for kind, b in parse_glob(glob))
    return "(?s)^" + out.decode() + "$"


@dataclass
class GlobAutomaton:
    """Shift-And over many globs; ``match`` returns a boolean row for each string."""

    globs: list[str]
    advance: np.ndarray = field(init=False)
    loop: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)
    final_bit: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        parsed = [parse_glob(g) for g in self.globs]
        states = sum(sum(kind in ("lit", "any") for kind, _ in p) + 1 for p in parsed)
        words = max(1, -(-states // 64))
        self.advance = np.zeros((256, words), np.uint64)
        self.loop = np.zeros((256, words), np.uint64)
        self.start = np.zeros(words, np.uint64)
        self.final_bit = np.zeros(len(parsed), np.int64)
        slash, bit = ord("/"), 0
        for k, p in enumerate(parsed):
            self._set(self.start, bit)
            for kind, b in p:
                if kind in ("run", "all"):
                    for c in range(256):
                        if kind == "all" or c != slash:
                            self._set(self.loop[c], bit)
                    continue
                bit += 1
                for c in [b] if kind == "lit" else [c for c in range(256) if c != slash]:
                    self._set(self.advance[c], bit)
            self.final_bit[k] = bit
            bit += 1

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << (bit % 64))

    def match(self, strings: list[bytes]) -> np.ndarray:
        n = len(strings)
        if n == 0 or len(self.globs) == 0:
            return np.zeros((n, len(self.globs)), bool)
        lengths = np.fromiter(map(len, strings), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[order]
        flat = np.frombuffer(b"".join(strings[i] for i in order) or b"\0", np.uint8)
        offsets = np.concatenate([[0], np.cumsum(sorted_lengths)[:-1]])
        state = np.repeat(self.start[None, :], n, axis=0)
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for t in range(int(sorted_lengths[0])):
            live = int(np.searchsorted(-sorted_lengths[:live], -t, side="left"))
            c = flat[offsets[:live] + t]
            d = state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:live] = (moved & self.advance[c]) | (d & self.loop[c])
        out = np.empty((n, len(self.globs)), bool)
        word, shift = self.final_bit // 64, (self.final_bit % 64).astype(np.uint64)
        out[order] = (state[:, word] >> shift) & one != 0
        return out


class UrlJudge:
    """Host rules by longest match, then globs by longest match, then ``default``."""

    def __init__(self, host_rules=HOST_RULES, glob_rules=GLOB_RULES, default: str = "allow") -> None:
        self.default = default
        self.rules = [(f"{h}{p}", v) for h, p, v in host_rules]
        self.globs = list(glob_rules)
        quoted = [re.sub(r"([*?\\])", r"\\\1", f"{h}{p}") for h, p, _ in host_rules]
        patterns = [g for q in quoted for g in (q + "**", "*." + q + "**")] + [g for g, _ in glob_rules]
        self.automaton = GlobAutomaton(patterns)
        # numbers by falling length, so that the first that matches is the longest; equal lengths: the first in the list
        self._rule_order = sorted(range(len(self.rules)), key=lambda i: -len(self.rules[i][0]))
        self._glob_order = sorted(range(len(self.globs)), key=lambda i: -len(self.globs[i][0]))

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list, list, list]:
        hit = self.automaton.match([(h + p).encode() for h, p in zip(hosts, paths)])
        r = len(self.rules)
        by_rule = self._longest(hit[:, 0 : 2 * r : 2] | hit[:, 1 : 2 * r : 2], self._rule_order)
        by_glob = self._longest(hit[:, 2 * r :], self._glob_order)
        rule = [None if k < 0 else self.rules[k][0] for k in by_rule]
        glob = [None if g < 0 else self.globs[g][0] for g in by_glob]
        verdict = [self.rules[k][1] if k >= 0 else self.globs[g][1] if g >= 0 else self.default for k, g in zip(by_rule, by_glob)]
        return rule, verdict, glob

    @staticmethod
    def _longest(hit: np.ndarray, order: list[int]) -> list[int]:
        """For each row the first column in ``order`` that is set, -1 if none."""
        if not order:
            return [-1] * len(hit)
        ordered = hit[:, order]
        first = ordered.argmax(axis=1)
        return np.where(ordered[np.arange(len(hit)), first], np.array(order)[first], -1).tolist()


def canonical_parts(url):
    """(host, path) columns of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, path


def filter_urls(df: DataFrame, id_col: str, url_col: str, judge: UrlJudge | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, glob) for each row; one pass, no shuffle."""
    judge = judge or UrlJudge()
    host, path = canonical_parts(F.col(url_col))
    parts = df.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    schema = "id long, host string, path string, rule string, verdict string, glob string"

    def run(batches):
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rule, verdict, glob = judge.judge(hosts, paths)
            text = [pa.array(x, pa.string()) for x in (rule, verdict, glob)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *text],
                names=["id", "host", "path", "rule", "verdict", "glob"],
            )

    return parts.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def oracle(judge: UrlJudge | None = None) -> str:
    """DuckDB SQL for the whole result, with one regular expression a rule."""
    judge = judge or UrlJudge()
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def case(items, get):
        return " ".join(f"WHEN {cond} THEN {get(i)}" for i, cond in items)

    rules = []
    for i in judge._rule_order:
        h, _, p = judge.rules[i][0].partition("/")
        p = "/" + p
        rules.append((i, f"((host = {quote(h)} OR ends_with(host, {quote('.' + h)})) AND starts_with(path, {quote(p)}))"))
    globs = [(g, f"regexp_matches(host || path, {quote(glob_to_regex(judge.globs[g][0]))})") for g in judge._glob_order]
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM rest),
hit AS (
  SELECT *, CASE {case(rules, lambda i: i)} END AS r, CASE {case(globs, lambda i: i)} END AS g FROM parts)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN r = {i} THEN {quote(judge.rules[i][0])}" for i in range(len(judge.rules)))} END AS rule,
       CASE {" ".join(f"WHEN r = {i} THEN {quote(judge.rules[i][1])}" for i in range(len(judge.rules)))}
            {" ".join(f"WHEN g = {i} THEN {quote(judge.globs[i][1])}" for i in range(len(judge.globs)))}
            ELSE {quote(judge.default)} END AS verdict,
       CASE {" ".join(f"WHEN g = {i} THEN {quote(judge.globs[i][0])}" for i in range(len(judge.globs)))} END AS glob
FROM hit"""
