"""URL filters by a bit-parallel wildcard automaton: all rules at once over each canonical URL.

A canonical URL is the lower-case host followed by the path. Rules are globs over the whole of it: ``?`` is any one
character but ``/``, ``*`` any run of such characters, ``**`` any run at all; every other character is itself. A rule
of m characters holds m + 1 bits of a row of 64-bit words, bit i saying that its first i characters are
matched; rules lie side by side. One character moves all rules on by a shift, with carries between words, and two
masks: bits whose next character it is, and bits that a run lets stay. Batches of URLs are read position by
position, longest first, so that no URL is padded.

Site rules name a host and a path: a rule fits its host and all subdomains where the path starts with the rule's, and
the longest one wins. Where none fits, the first glob of a list decides, and where none of these fits, the
default verdict. Work a character grows with the words of all rules, some six site rules or globs to a word.

The host is what lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the
path what follows up to ``?``, ``#`` or the end. A null URL or one without ``://`` has an empty host and path. Repeated
rows are judged each on its own; an empty table gives an empty result. Only the named columns are read, so that no
other column can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselab.llm.common import dealt

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Site(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Glob(NamedTuple):
    verdict: str
    glob: str


#: The rules of the registered query, and the globs of hosts and paths that it falls back on.
SITES = (Site("allow", "com", "/"), Site("block", "example.com", "/en/"), Site("allow", "www.example.com", "/en/"), Site("block", "net", "/es/"), Site("block", "net", "/fr/"))
GLOBS = tuple(
    Glob("block", g)
    for g in ("*casino**", "*-pills**", "*-bets**", "ads-**", "*.ads-**", "spam-**", "*.spam-**", "**/wp-admin/**", "**/login", "**/login/**", "**/cart/**", "**.exe", "**.zip")
)


class Automaton:
    """Globs packed into words; ``matches`` tells for each text which of them fit it."""

    def __init__(self, globs: Sequence[str]):
        steps, loops, self.starts, self.ends = [], [], [], []  # a bit's own character, and the run that may follow it
        for g in globs:
            self.starts.append(len(steps))
            steps.append(None)
            loops.append("")
            for token in re.findall(r"\*+|[^*]", g):
                if token[0] == "*":
                    loops[-1] = max(loops[-1], token[:2], key=len)
                else:
                    steps.append(token)
                    loops.append("")
            self.ends.append(len(steps) - 1)
        self.words = max(1, -(-len(steps) // 64))
        self.known = np.unique([ord(c) for c in {"/", *(s for s in steps if s and s != "?")}]).astype(np.uint32)
        signs = [*map(chr, self.known.tolist()), None]  # the last class: any character that no rule names
        self.move = np.array([self._bits([s is not None and (s == c or (s == "?" and c != "/")) for s in steps]) for c in signs], np.uint64)
        self.stay = np.array([self._bits([r == "**" or (r == "*" and c != "/") for r in loops]) for c in signs], np.uint64)
        self.begin = self._bits([i in set(self.starts) for i in range(len(steps))])

    def _bits(self, flags: Sequence[bool]) -> np.ndarray:
        padded = np.zeros(self.words * 64, np.uint8)
        padded[: len(flags)] = flags
        return np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """A matrix of truth values: row for text, column for glob."""
        lens = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lens, kind="stable")
        flat = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.known, flat)
        kind = np.where(self.known[np.minimum(at, len(self.known) - 1)] == flat, at, len(self.known)) if len(flat) else at
        lens = lens[order]
        first = np.cumsum(lens) - lens
        state = np.repeat(self.begin[None], len(texts), 0)
        live = len(texts)
        for p in range(int(lens.max(initial=0))):
            while lens[live - 1] <= p:
                live -= 1
            now, c = state[:live], kind[first[:live] + p]
            shifted = now << np.uint64(1)
            if self.words > 1:
                shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (shifted & self.move[c]) | (now & self.stay[c])
        ends = np.array(self.ends, np.int64)
        hit = (state[:, ends // 64] >> (ends % 64).astype(np.uint64)) & np.uint64(1)
        out = np.zeros(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, UPPER.lower()), F.regexp_extract(url, URL, 2)


def _globs(site: Site) -> tuple[str, str]:
    """A site rule as globs: its host, and any of its subdomains."""
    return f"{site.name}**", f"*.{site.name}**"


def judge(df: DataFrame, sites: Sequence[Site] = SITES, globs: Sequence[Glob] = GLOBS, default: str = "allow", key: str = "page_id") -> DataFrame:
    """``key``, host, path, rule, verdict and glob of every row; ``rule`` and ``glob`` are null where none fits.

    Site rules hold literal hosts and paths, without wildcards.
    """
    if any(c in s.name for s in sites for c in "*?"):
        raise ValueError("a site rule names a literal host and path; use a glob for wildcards")
    ranked = sorted(sites, key=lambda s: -len(s.name))
    patterns = [g for s in ranked for g in _globs(s)] + [g.glob for g in globs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(patterns)
        for b in batches:
            fits = automaton.matches((b["host"] + b["path"]).tolist())
            by_site = fits[:, : 2 * len(ranked)].reshape(len(b), len(ranked), 2).any(2)
            by_glob = fits[:, 2 * len(ranked) :]
            rule, glob, verdict = [], [], []
            for s, g in zip(by_site, by_glob):
                site, other = s.argmax() if s.any() else None, g.argmax() if g.any() else None
                rule.append(None if site is None else ranked[site].name)
                glob.append(None if other is None else globs[other].glob)
                verdict.append(ranked[site].verdict if site is not None else globs[other].verdict if other is not None else default)
            yield b.assign(rule=pd.Series(rule, b.index, object), verdict=verdict, glob=pd.Series(glob, b.index, object))

    host, path = canonical(F.coalesce("url", F.lit("")))
    rows = dealt(df.select(F.col(key).alias("key"), "url")).select("key", host.alias("host"), path.alias("path"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, host string, path string, rule string, verdict string, glob string").withColumnRenamed("key", key)
