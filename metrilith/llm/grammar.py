"""Secrets found by the formats of credentials: probabilistic automata inferred from labelled examples.

Every text is read for matches of fixed patterns, the labelled credentials, and for other
runs of credential letters, the candidates. Letters stand for classes (digits, hexadecimal
letters and others in either case, marks as themselves), and all labelled values are counted
as classes: by prefix, over the whole corpus, in Spark. What reaches the driver are prefixes
that hold a fair share of a kind's examples, whose number that share bounds. There the
prefix tree of each kind becomes an automaton: going through the tree from the root, a state
is merged into an earlier one if the shares of letters and endings that follow agree by
Hoeffding's bound, there and in all states below; else it stays. The other runs of the
corpus give the automaton of the background in the same way.

A candidate's score for a kind is how much likelier its letters are under that kind's
automaton than under the background's, in bits. It becomes a span if the score is high enough
in all and for each letter, and if the automaton finds it about as likely as its own examples:
letters that neither has seen say nothing.
"""

from __future__ import annotations

import math
import os
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrilith.llm.common import id_and_text, slices, strings
from metrilith.operators.tables import Scratch


def _either(word: str) -> str:
    """The word with its ASCII letters in either case, and no others that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Kind: pattern, group that is the value, least length of it.
BASE = {
    "assign": (re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]{24,}"), 0, 24),
}
#: Texts without any of these, in lower case, have no match of the kind.
_NEEDS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",)}
#: Added spans have the kind of the automaton that scores highest, with this before it.
ADDED = "like_"
BACKGROUND = "background"
#: A candidate is a whole run of so many letters or more.
CANDIDATE = 16
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{CANDIDATE},}}")

#: Classes of letters: digits, a to f, g to z, the same in capitals, marks; other letters don't occur.
SYMBOLS = "0fzFZ+/_.=-"
_CLASS = {**{ord(c): "0" for c in "123456789"}, **{ord(c): "f" for c in "abcde"}, **{c: "z" for c in range(ord("g"), ord("z"))}, **{ord(c): "F" for c in "ABCDE"}, **{c: "Z" for c in range(ord("G"), ord("Z"))}}
#: Letters that one count of prefixes goes down; longer ones that many values share are counted on from there.
STRETCH = 32
#: A prefix has a node if it holds one in so many of its kind's values, and this many at least: at most SHARE nodes of each length and kind.
SHARE, FEWEST = 256, 8
#: Kinds with fewer labelled values have no automaton.
LABELLED = 20
#: Confidence of the Hoeffding bound: smaller merges more.
ALPHA = 0.01
#: Bits in all, and for each letter, by which a credential's format has to be the likelier one.
BITS, BITS_A_LETTER = 10.0, 0.4
#: Bits for each letter by which it may be less likely than the kind's examples are on average.
SLACK = 1.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of kind, end, value) of all matches of the fixed patterns, by start, then kind."""
    low = text.lower()
    found = []
    for k, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        if kind not in _NEEDS or any(w in low for w in _NEEDS[kind]):
            found += [(m.start(), k, m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of the runs of credential letters that touch no span of `base`."""
    starts = [x[0] for x in base]
    ends = list(accumulate((x[2] for x in base), max))
    out = []
    for m in _RUN.finditer(text):
        before = bisect_right(starts, m.end() - 1)
        if not before or ends[before - 1] <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


def prefixes(values: DataFrame, keys: tuple[str, ...] = ("kind",)) -> DataFrame:
    """(kind, prefix, n, ended, next): for each prefix of the values' classes how many have it, end with it and go on with which.

    `values` has (kind, value, n): n examples of one sequence of classes. Values are counted
    whole before their prefixes are. Prefixes have up to STRETCH letters; `trees` goes on from those.
    """
    v = F.left("value", F.lit(STRETCH + 1))
    whole = values.groupBy(*keys, v.alias("value")).agg(F.sum("n").alias("n"))
    at = F.explode(F.sequence(F.lit(0), F.least(F.length("value"), F.lit(STRETCH)))).alias("at")
    letter = F.substring("value", F.col("at") + 1, F.lit(1))
    steps = whole.select(*keys, "value", "n", at).select(*keys, F.substring("value", F.lit(1), F.col("at")).alias("prefix"), letter.alias("letter"), "n")
    counted = steps.groupBy(*keys, "prefix", "letter").agg(F.sum("n").alias("n"))
    pairs = F.map_from_entries(F.collect_list(F.when(F.col("letter") != "", F.struct("letter", "n"))))
    ended = F.sum(F.when(F.col("letter") == "", F.col("n")).otherwise(0))
    return counted.groupBy(*keys, "prefix").agg(F.sum("n").alias("n"), ended.alias("ended"), pairs.alias("next"))


def trees(values: DataFrame) -> dict[str, dict[str, tuple[int, int, dict[str, int]]]]:
    """Kind to prefix tree: each prefix, of any length, that holds a fair share of the kind's values, to (n, ended, next).

    Prefixes are counted a stretch at a time. A prefix has a node only if the shorter ones
    have, so that the next stretch needs no other values than those that begin with a node of the last
    one's full length. Letters that all values of such a node have in common are passed over at
    once: there is a stretch more only where values that share so much part again.
    """
    spark, scratch = values.sparkSession, Scratch(values.sparkSession, "grammar")
    # a stem is a prefix that values have been cut off, by its number
    held = rest = scratch.write(values.groupBy("kind", "value").agg(F.sum("n").alias("n")).withColumn("stem", F.lit(0)), "values")
    least = {r["kind"]: float(max(FEWEST, r["n"] / SHARE)) for r in rest.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    fair = F.broadcast(spark.createDataFrame(list(least.items()), "kind string, least double"))
    out: dict[str, dict] = {}
    stems = [""]
    while True:
        nodes = scratch.write(prefixes(rest, ("kind", "stem")).join(fair, "kind").filter("n >= least").drop("least"), "prefixes")
        full = []
        for r in nodes.toLocalIterator():
            # a stem was counted with what ends there before its values were cut
            out.setdefault(r["kind"], {}).setdefault(stems[r["stem"]] + r["prefix"], (r["n"], r["ended"], r["next"]))
            if len(r["prefix"]) == STRETCH and r["n"] - r["ended"] >= least[r["kind"]]:
                full.append((r["kind"], r["stem"], r["prefix"], len(stems)))
                stems.append(stems[r["stem"]] + r["prefix"])
        scratch.drop(nodes)
        if not full:
            scratch.drop(held)
            return out
        asked = F.broadcast(spark.createDataFrame(full, "kind string, stem int, prefix string, to int"))
        cut = rest.withColumn("prefix", F.left("value", F.lit(STRETCH))).join(asked, ["kind", "stem", "prefix"])
        after = lambda n: F.substring("value", n + 1, F.length("value"))
        longer = scratch.write(cut.select("kind", F.col("to").alias("stem"), after(F.lit(STRETCH)).alias("value"), "n").filter("value <> ''"), "values")
        scratch.drop(held)
        held, passed = longer, []
        for r in longer.groupBy("kind", "stem").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("n")).collect():
            common = os.path.commonprefix([r["low"], r["high"]])
            for k, letter in enumerate(common):
                out[r["kind"]].setdefault(stems[r["stem"]] + common[:k], (r["n"], 0, {letter: r["n"]}))
            stems[r["stem"]] += common
            passed.append((r["kind"], r["stem"], len(common)))
        passed = F.broadcast(spark.createDataFrame(passed, "kind string, stem int, passed int"))
        rest = longer.join(passed, ["kind", "stem"]).select("kind", "stem", after(F.col("passed")).alias("value"), "n")


class Automaton:
    """A probabilistic automaton: for each state the chance of each letter and of an end, and the state that follows."""

    def __init__(self, tree: dict[str, tuple[int, int, dict[str, int]]], alpha: float = ALPHA):
        """`tree`: prefix to (n, ended, {letter: n}); all prefixes of a prefix are in it."""
        # nodes go by their place in the order of their letters
        at = {p: k for k, p in enumerate(sorted(tree))}
        self.n = {at[p]: x[0] for p, x in tree.items()}
        self.ended = {at[p]: x[1] for p, x in tree.items()}
        self.out = {at[p]: Counter(x[2]) for p, x in tree.items()}
        self.next = {at[p]: {a: at[p + a] for a in x[2] if p + a in at} for p, x in tree.items()}
        self._width = math.sqrt(0.5 * math.log(2 / alpha))
        kept, front = [0], [(0, a) for a in sorted(self.next[0])]
        self._shares, self._slack, self._row = np.zeros((64, len(SYMBOLS) + 1)), np.zeros(64), {}
        self._note(0)
        while front:
            # the state most examples come to goes first; ties by its letters
            front.sort(key=lambda e: (-self.n[self.next[e[0]][e[1]]], e))
            state, letter = front.pop(0)
            child = self.next[state][letter]
            into = next((q for q in (kept[k] for k in self._near(child)) if self._alike(q, child)), None)
            if into is None:
                kept.append(child)
                self._note(child)
                front += [(child, a) for a in self.next[child]]
                continue
            self.next[state][letter] = into
            self._fold(into, child)
            known = set(kept)
            front = [(q, a) for q in kept for a, to in self.next[q].items() if to not in known]
        self.number = {q: k for k, q in enumerate(kept)}
        self.chance, self.end, self.follow = [], [], []
        for q in kept:
            # half an example of each letter and of an end beforehand
            total = math.log2(self.n[q] + 0.5 * (len(SYMBOLS) + 1))
            self.chance.append({a: math.log2(self.out[q][a] + 0.5) - total for a in SYMBOLS})
            self.end.append(math.log2(self.ended[q] + 0.5) - total)
            # prefixes without a node go on like their state
            self.follow.append({a: self.number[self.next[q].get(a, q)] for a in SYMBOLS})
        told = sum(self.ended[q] * self.end[k] + sum(n * self.chance[k][a] for a, n in self.out[q].items()) for q, k in self.number.items())
        #: Mean bits of a letter, or an end, of the examples.
        self.typical = told / max(sum(self.n[q] for q in kept), 1)
        del self.n, self.ended, self.out, self.next, self.number, self._shares, self._slack, self._row

    def _split(self, q: int) -> tuple[list[float], float]:
        """A state's shares of endings and letters, and how far off each may be."""
        n = self.n[q]
        return [x / n if n else 0.0 for x in (self.ended[q], *(self.out[q][a] for a in SYMBOLS))], self._width / math.sqrt(n) if n else math.inf

    def _note(self, q: int) -> None:
        """Write down a kept state's shares, as they are now."""
        k = self._row.setdefault(q, len(self._row))
        if k == len(self._slack):
            self._shares, self._slack = np.vstack((self._shares, np.zeros_like(self._shares))), np.concatenate((self._slack, np.zeros_like(self._slack)))
        self._shares[k], self._slack[k] = self._split(q)

    def _near(self, p: int) -> list[int]:
        """Places of the kept states that agree with `p` in what follows at once; the others can't be alike."""
        shares, slack = self._split(p)
        k = len(self._row)
        # rounding may not rule a state out
        return np.flatnonzero((np.abs(self._shares[:k] - shares) <= self._slack[:k, None] + (slack + 1e-9)).all(1)).tolist()

    def _same(self, a: int, n: int, b: int, m: int) -> bool:
        return not n or not m or abs(a / n - b / m) <= self._width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _alike(self, q: int, p: int) -> bool:
        ahead = [(q, p)]
        while ahead:
            q, p = ahead.pop()
            n, m = self.n[q], self.n[p]
            if not self._same(self.ended[q], n, self.ended[p], m):
                return False
            if not all(self._same(self.out[q][a], n, self.out[p][a], m) for a in self.out[q].keys() | self.out[p].keys()):
                return False
            ahead += [(self.next[q][a], to) for a, to in self.next[p].items() if a in self.next[q]]
        return True

    def _fold(self, q: int, p: int) -> None:
        """Add the tree below `p`, which nothing else leads to, to state `q`."""
        ahead = [(q, p)]
        while ahead:
            q, p = ahead.pop()
            self.n[q] += self.n[p]
            self.ended[q] += self.ended[p]
            self.out[q].update(self.out[p])
            if q in self._row:
                self._note(q)
            for a, to in self.next[p].items():
                if a in self.next[q]:
                    ahead.append((self.next[q][a], to))
                else:
                    self.next[q][a] = to

    def bits(self, value: str) -> float:
        """log2 of the chance of a value, given as classes."""
        state, total = 0, 0.0
        for a in value:
            total += self.chance[state][a]
            state = self.follow[state][a]
        return total + self.end[state]


def classes(value: str) -> str:
    """A value's letters as the names of their classes."""
    return value.translate(_CLASS)


def infer(values: DataFrame, labelled: int = LABELLED) -> dict[str, Automaton]:
    """An automaton for each kind of `values` (kind, value as classes, n) with enough of them, and always one of the background.

    All values are counted; only nodes with a fair share of a kind's values are gathered. An
    empty table leaves the background alone, with all letters alike.
    """
    kept = {kind: Automaton(t) for kind, t in sorted(trees(values).items()) if kind == BACKGROUND or t[""][0] >= labelled}
    return {BACKGROUND: Automaton({"": (0, 0, {})})} | kept


def _values(batches):
    for batch in slices(batches):
        seen: Counter = Counter()
        for text in strings(batch.column("text")):
            base = base_spans(text)
            names = list(BASE)
            seen.update((names[k], classes(v)) for _, k, _, v in base)
            seen.update((BACKGROUND, classes(v)) for _, _, v in candidates(text, base))
        rows = [(k, v, n) for (k, v), n in sorted(seen.items())]
        yield pa.RecordBatch.from_pydict({"kind": [r[0] for r in rows], "value": [r[1] for r in rows], "n": [r[2] for r in rows]}, pa.schema([("kind", pa.string()), ("value", pa.string()), ("n", pa.int64())]))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Automaton]:
    """Automata from the credentials that the fixed patterns label in all texts, and the background from all other runs."""
    return infer(id_and_text(docs, id_col, text_col).mapInArrow(_values, "kind string, value string, n bigint"))


def score(value: str, automata: dict[str, Automaton], slack: float = math.inf) -> tuple[float, str]:
    """(bits, kind): by how much the likeliest kind beats the background, and which it is.

    Only kinds whose examples are no more than `slack` bits a letter likelier count; with
    none it is minus infinity.
    """
    v = classes(value)
    ground = automata[BACKGROUND].bits(v)
    found = ((a.bits(v), a.typical, k) for k, a in automata.items() if k != BACKGROUND)
    return max(((x - ground, k) for x, typical, k in found if x >= (typical - slack) * (len(v) + 1)), default=(-math.inf, ""))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def detect(docs: DataFrame, automata: dict[str, Automaton], bits: float = BITS, bits_a_letter: float = BITS_A_LETTER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each row of `docs`: all spans by start, then kind, each with kind, start, end and score in bits.

    Matches of the fixed patterns are spans whatever their score; a candidate is one if it
    passes both thresholds. Places count code points, ends are exclusive. Null and empty
    texts have none, repeated rows are rows of their own, null ids stay, and an empty table
    gives an empty one. The automata go to the tasks with the function; SHARE bounds their
    states of one length, and the longest prefix that many values share the lengths.
    """
    names = list(BASE)

    def found(text: str) -> list[dict]:
        base = base_spans(text)
        out = [(s, k, e, names[k], score(v, automata)[0]) for s, k, e, v in base]
        for s, e, v in candidates(text, base):
            x, kind = score(v, automata, SLACK)
            if x >= bits and x >= bits_a_letter * len(v):
                out.append((s, len(names) + names.index(kind), e, ADDED + kind, x))
        return [{"kind": kind, "start": s, "end": e, "score": round(x, 3) if math.isfinite(x) else None} for s, _, e, kind, x in sorted(out)]

    def run(batches):
        for batch in slices(batches):
            spans = pa.array([found(t) for t in strings(batch.column("text"))], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], names=["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:int,end:int,score:double>>")
