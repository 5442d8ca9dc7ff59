"""URL filters by a bit-parallel wildcard automaton.

All rules are packed into one multiword Shift-And machine. A rule of m
elements owns m + 1 neighbouring bits: bit i is set while its first i
elements have been read. One step for a byte c is

    D = ((D << 1) & ENTER[c]) | (D & STAY[c])

where ENTER marks the bits an element reading c leads to and STAY the bits
after which a ``*`` stands that may swallow c. The step runs over all URLs of a batch
at once, and over all words of D that can matter to them: the rules of a host and its subdomains can only
fit URLs whose host ends in the same two labels (or one), so they lie in words of their own, and a URL
takes these words and those of the globs along. So a URL costs its length times a few words, however many rules
there are; ``LANES`` pairs of a URL and a word are in memory at a time. The tables are broadcast.

The canonical form of a URL is ``.`` host 0xFF path: 0xFF is in no UTF-8 text, so
a host wildcard can stop there and a rule can't be met inside the path. Host: what
follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
Path: then up to ``?``, ``#`` or the end. Null, or no ``://``: both empty.

Rows are judged one by one, without a shuffle. A null page_id stays null. Very long URLs are read to their end. Repeated rows get the same
verdict each, an empty table gives an empty one, other columns (whatever their names) are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waytrace.llm.common import table, texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
EDGE = 0xFF
LANES = 1 << 16


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: action, host, path; the longest rule that fits decides.
RULES = [
    HostRule("block", "com", "/en/"),
    HostRule("allow", "example.com", "/en/7"),
    HostRule("allow", "net", "/de/"),
    HostRule("block", "example.net", "/de/8"),
    HostRule("block", "org", "/es/"),
]
#: Globs over host and path that block where no rule fits. ``*``: any run, within the host up to its end; ``?``: one byte.
GLOBS = [
    "*spam-farm.*", "*cheap-pills.*", "*casino*", "*payday-loan*", "*free-download*", "ads.*", "ad.*", "adserver.*", "tracker.*", "*.doubleclick.net", "*click-here*", "*replica-watch*",
    "*/wp-login.php", "*/wp-admin/*", "*/xmlrpc.php", "*/cgi-bin/*", "*/trackback/", "*/.git/*", "*/.env", "*/phpmyadmin/*", "*/redirect/http*", "*/calendar/*/*/*/print", "mirror*/pub/*", "*/admin/login*",
]


class Automaton:
    """Patterns (first, elements) by the host ending they are for (None: all hosts); elements are (bytes that lead on, bytes that may
    be swallowed behind it)."""

    def __init__(self, patterns: list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]], endings: list[bytes | None]) -> None:
        order = sorted(range(len(patterns)), key=lambda i: (endings[i] is not None, endings[i] or b"", i))
        self.range_of: dict[bytes | None, tuple[int, int]] = {None: (0, 0)}
        at, places = 0, []
        for n, i in enumerate(order):
            if n and endings[i] != endings[order[n - 1]]:
                at = -(-at // 64) * 64
            places.append((i, at))
            begin = self.range_of.get(endings[i], (at // 64, 0))[0]
            at += len(patterns[i][1]) + 1
            self.range_of[endings[i]] = (begin, -(-at // 64))
        self.words = max(1, -(-at // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.accepts = np.zeros(self.words, np.uint64)
        self.pattern_at: dict[tuple[int, int], int] = {}
        for i, at in places:
            first, elements = patterns[i]
            word, bit = self._place(at)
            self.start[word] |= bit
            self.stay[first, word] |= bit
            for leads, swallows in elements:
                at += 1
                word, bit = self._place(at)
                self.enter[leads, word] |= bit
                self.stay[swallows, word] |= bit
            self.accepts[word] |= bit
            self.pattern_at[word, at % 64] = i

    @staticmethod
    def _place(at: int) -> tuple[int, np.uint64]:
        return at // 64, np.uint64(1) << np.uint64(at % 64)

    def _words_for(self, key: bytes) -> list[tuple[int, int]]:
        labels = key[1 : key.index(EDGE)].rsplit(b".", 2)
        found = [self.range_of[None], self.range_of.get(labels[-1]), self.range_of.get(b".".join(labels[-2:])) if len(labels) > 1 else None]
        return [r for r in found if r and r[0] < r[1]]

    def match(self, keys: list[bytes]) -> list[tuple[int, int]]:
        """(key, pattern) of each pattern that reads a key to its end."""
        order = sorted(range(len(keys)), key=lambda i: -len(keys[i]))
        found, rows, lanes = [], [], 0
        for i in order:
            ranges = self._words_for(keys[i])
            rows.append((i, ranges))
            lanes += sum(b - a for a, b in ranges)
            if lanes >= LANES:
                found += self._run(keys, rows)
                rows, lanes = [], 0
        return found + self._run(keys, rows) if rows else found

    def _run(self, keys: list[bytes], rows: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int]]:
        """Reads the keys of ``rows``, longest first, a lane for each key and word."""
        sizes = np.array([len(keys[i]) for i, _ in rows])
        flat = np.frombuffer(b"".join([keys[i] for i, _ in rows]), np.uint8)
        lane_row = np.repeat(np.arange(len(rows)), [sum(b - a for a, b in r) for _, r in rows])
        word = np.array([w for _, r in rows for a, b in r for w in range(a, b)], np.int64)
        if not len(word):
            return []
        joined = np.flatnonzero(np.concatenate(([False], (word[1:] == word[:-1] + 1) & (lane_row[1:] == lane_row[:-1]))))
        begins, ends = (np.cumsum(sizes) - sizes)[lane_row], sizes[lane_row]
        state = self.start[word]
        enter, stay = self.enter.reshape(-1), self.stay.reshape(-1)
        one, top, alive = np.uint64(1), np.uint64(63), len(word)
        for step in range(int(sizes[0])):
            if ends[alive - 1] <= step:
                alive = int(np.searchsorted(-ends, -step, side="left"))
            if joined[-1:].sum() >= alive:
                joined = joined[joined < alive]
            at = flat[begins[:alive] + step].astype(np.int64) * self.words + word[:alive]
            now = state[:alive]
            moved = now << one
            # a range's words follow each other; what another range's last bit hands on is masked by ENTER
            moved[joined] |= now[joined - 1] >> top
            state[:alive] = (moved & enter[at]) | (now & stay[at])
        hits = state & self.accepts[word]
        found = []
        for lane in np.flatnonzero(hits).tolist():
            bits, w = int(hits[lane]), int(word[lane])
            found += [(rows[lane_row[lane]][0], self.pattern_at[w, b]) for b in range(64) if bits >> b & 1]
        return found


NONE = np.zeros(256, bool)
ANY = np.ones(256, bool)
IN_HOST = np.arange(256) != EDGE


def _only(byte: int) -> np.ndarray:
    return np.arange(256) == byte


def host_pattern(rule: HostRule) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    body = b"." + rule.host.encode() + bytes([EDGE]) + rule.path.encode()
    elements = [[_only(b), NONE] for b in body]
    elements[-1][1] = ANY
    return IN_HOST, [tuple(e) for e in elements]


def glob_pattern(glob: str) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """``host/path`` with wildcards; without a ``/`` the glob is of the host and any path fits."""
    host, slash, path = glob.partition("/")
    first, elements = NONE, [[_only(ord(".")), NONE]]
    for part, swallow in ((host, IN_HOST), (slash + path if slash else "*", ANY)):
        if swallow is ANY:
            elements.append([_only(EDGE), NONE])
        for ch in part:
            if ch == "*":
                elements[-1][1] = swallow
            elif ch == "?":
                elements.append([swallow, NONE])
            else:
                elements += [[_only(b), NONE] for b in ch.encode()]
    return first, [tuple(e) for e in elements]


def ending_of(rule: HostRule) -> bytes | None:
    """What hosts that the rule fits end in: two labels at most."""
    return b".".join(rule.host.encode().rsplit(b".", 2)[-2:]) or None


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def judge_urls(
    pages: DataFrame,
    rules: list[HostRule] | None = None,
    globs: list[str] | None = None,
    default: str = "allow",
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, glob) for every row of ``pages``.

    Among the rules that fit the longest (host and path together; then the
    longer host; then the earlier one) gives rule and verdict. Without one, a fitting
    glob blocks and ``glob`` names the first; else ``default``.
    """
    rules = RULES if rules is None else rules
    globs = GLOBS if globs is None else globs
    ranked = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    machine = Automaton([host_pattern(r) for r in ranked] + [glob_pattern(g) for g in globs], [ending_of(r) for r in ranked] + [None] * len(globs))
    held = pages.sparkSession.sparkContext.broadcast(machine)
    names = np.array([r.name for r in ranked] + [None], object)
    actions = np.array([r.action for r in ranked] + [None], object)
    labels = np.array([*globs, None], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [b"." + h + b"\xff" + p for h, p in zip(texts(batch.column(1)), texts(batch.column(2)), strict=True)]
            rule, glob = np.full(len(keys), len(ranked)), np.full(len(keys), len(globs))
            for row, pattern in held.value.match(keys):
                if pattern < len(ranked):
                    rule[row] = min(rule[row], pattern)
                else:
                    glob[row] = min(glob[row], pattern - len(ranked))
            verdict = np.where(rule < len(ranked), actions[rule], np.where(glob < len(globs), "block", default))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[rule], pa.string()), pa.array(verdict, pa.string()), pa.array(labels[glob], pa.string())],
                names=[*batch.schema.names, "rule", "verdict", "glob"],
            )

    url = F.col(url_column)
    keyed = pages.select(F.col(id_column).cast("long").alias(id_column), url_host(url).alias("host"), url_path(url).alias("path"))
    return keyed.mapInArrow(run, f"{id_column} long, host string, path string, rule string, verdict string, glob string")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every url of ``pages``."""
    return judge_urls(table(spark, sf_dir, "pages"))


_FITS = [
    (f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')", r)
    for r in sorted(RULES, key=lambda r: (-len(r.name), -len(r.host)))
]


def _like(column: str, glob: str) -> str:
    pattern = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return f"{column} LIKE '{pattern}' ESCAPE '\\'"


def _glob_fit(glob: str) -> str:
    host, slash, path = glob.partition("/")
    return f"({_like('host', host)}" + (f" AND {_like('path', slash + path)})" if slash else ")")


_GLOB_FITS = [(_glob_fit(g), g) for g in GLOBS]
ORACLE = f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE {" ".join(f"WHEN {fit} THEN '{r.name}'" for fit, r in _FITS)} END AS rule,
         CASE {" ".join(f"WHEN {fit} THEN '{r.action}'" for fit, r in _FITS)} END AS action,
         CASE {" ".join(f"WHEN {fit} THEN '{g}'" for fit, g in _GLOB_FITS)} END AS "glob"
  FROM parts)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN "glob" IS NULL THEN 'allow' ELSE 'block' END) AS verdict, "glob"
FROM judged
"""
