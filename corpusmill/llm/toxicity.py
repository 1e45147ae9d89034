"""Toxicity by a weighted finite-state grammar over clauses.

The *lexicon* is a letter trie that reads a word and writes a symbol: insult, threat verb, target, negation,
report, intent or other, with quotation marks as symbols of their own.  Its insults are known words and, learned
from labels, word beginnings that toxic documents share and clean ones lack.  Five letter transducers read the
symbols of one clause, each writing one symbol per symbol, and are composed into one machine:

* *target* guesses whether somebody is addressed in the clause and marks insults accordingly; a wrong guess
  does not reach a final state;
* *threat* turns the object of a threat verb into a threat, when the verb opens the clause or follows an intent
  and the object stands within two words of it (or just before it, for verbs that come last);
* *negation* turns insults and threats within three words of a negation into negated ones;
* *report* turns insults and threats behind a verb of saying or inside quotation marks into reported ones;
* *clause* reads what is left; each of its arcs for a match has a weight.

So ``not stupid`` or ``she wrote that he was called stupid`` weigh less than ``you are stupid``, and ``kill the
process you started`` is no threat.  A clause weighs what its best accepting path weighs.  A document's score is
a logistic function of the arcs that its clauses take, each counted up to three times, and of whether there is any
match that is neither negated nor reported.  Arc weights are fitted to the labels with the fixed weights as prior, so
an arc that no labelled text takes keeps its weight.  Words outside a match never count.

Learning uses at most ``TRAIN_DOCS`` distinct labelled texts, drawn by a hash of the text.  Only clauses with
an insult or a threat verb are walked; all words of all texts are looked up.

Nulls: null and empty texts have no clause and get the score of such texts; null ids and labels are left out of
learning.  Very long texts are one row and read whole.  Repeated rows give repeated rows; equal texts get equal
scores.  Without labels, or with one class only, fixed weights are used.  Empty tables give an empty result.  A
column of the score's name is replaced, other columns stay.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import annotate, documents, labelled_sample, remainder
from corpusmill.llm.registry import query
from corpusmill.llm.training import logistic, sigmoid
from corpusmill.session import read_table

#: Most labelled texts that learning looks at.
TRAIN_DOCS = 6000
THRESHOLD = 0.7
MEMO = 600_000

# Words of each symbol.
INSULTS = ("idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile jerk "
           "idiota idiotas estúpido estúpida imbécil idiote imbécile stupide idioten dummkopf trottel").split()
THREATS = "kill hurt destroy beat crush stab shoot burn hang strangle".split()
LAST_THREATS = "mataré mataremos tuer tuerai tuerons töten umbringen".split()
TARGETS = "you your yours yourself u they them him he her she everyone te os tu usted eres vous du dich euch ihn bist".split()
NEGATIONS = "not no never isn't aren't wasn't won't don't without nor nunca jamais pas nicht kein".split()
REPORTS = "said says say wrote writes told called reported quoted claimed according alleged dijo dit sagte".split()
INTENTS = "will gonna going shall should must want wanna i'll we'll let's werde werden vais voy".split()

OTHER, INSULT, STEM, THREAT, LAST_THREAT, TARGET, NEGATION, REPORT, INTENT, OPEN, CLOSE, AIMED, THREATENED, NEGATED, REPORTED = range(15)
READ = range(CLOSE + 1)
MATCHES = (INSULT, AIMED, STEM, THREATENED)
WORDS = ((INSULT, INSULTS), (THREAT, THREATS), (LAST_THREAT, LAST_THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENT, INTENTS))
#: The weighted arcs of the clause transducer.
OUTPUTS = ("plain", "aimed", "stem", "threat", "negated", "reported")
#: Weight of each arc before anything is learned, of any plain match in the document, and the offset.
DEFAULT_WEIGHTS = np.array([0.6, 1.2, 0.6, 2.5, 0.2, 0.3, 3.0, -3.0])
_NEGATION_SCOPE = 3
_THREAT_SCOPE = 2
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
_WORDS = re.compile(r"[^\W\d_]{4,}").findall
_OPENED, _CLOSED = 16, 32  # marks of a word's code beside its symbol
_SEEN = frozenset((INSULT, STEM, THREAT, LAST_THREAT))


@dataclass
class Transducer:
    """Reads a symbol and writes a symbol per arc; an arc's weight is a sum of named weights, given as their numbers."""

    starts: tuple
    finals: frozenset
    arcs: dict  # (state, symbol read) -> ((symbol written, weights, next state), ...)

    def paths(self, symbols: Iterable[int]) -> list[tuple[list[int], list[int]]]:
        """``(symbols written, weights)`` of every accepting path, one path after the other."""
        found = [(s, [], []) for s in self.starts]
        for x in symbols:
            found = [(to, [*out, y], [*took, *w]) for at, out, took in found for y, w, to in self.arcs.get((at, x), ())]
        return [(out, took) for at, out, took in found if at in self.finals]


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that lets ``b`` read what ``a`` writes; states that cannot be reached or cannot end are left out."""
    starts = tuple((p, q) for p in a.starts for q in b.starts)
    reads = sorted({x for _, x in a.arcs})
    arcs, todo, seen = {}, list(starts), set(starts)
    while todo:
        p, q = todo.pop()
        for x in reads:
            made = tuple((z, (*v, *w), (to, on)) for y, v, to in a.arcs.get((p, x), ()) for z, w, on in b.arcs.get((q, y), ()))
            if made:
                arcs[(p, q), x] = made
                new = {to for _, _, to in made} - seen
                seen |= new
                todo += new
    finals = frozenset(s for s in seen if s[0] in a.finals and s[1] in b.finals)
    before: dict = {}
    for (at, _), made in arcs.items():
        for _, _, to in made:
            before.setdefault(to, set()).add(at)
    live, todo = set(finals), list(finals)
    while todo:
        new = before.get(todo.pop(), set()) - live
        live |= new
        todo += new
    kept = {key: tuple(m for m in made if m[2] in live) for key, made in arcs.items() if key[0] in live}
    return Transducer(tuple(s for s in starts if s in live), finals, {key: made for key, made in kept.items() if made})


def target() -> Transducer:
    """``none``: nobody is addressed in the whole clause; ``want``: somebody will be; ``got``: somebody has been."""
    arcs = {}
    for x in READ:
        marked = AIMED if x == INSULT else x
        if x != TARGET:
            arcs["none", x] = ((x, (), "none"),)
        arcs["want", x] = ((marked, (), "got" if x == TARGET else "want"),)
        arcs["got", x] = ((marked, (), "got"),)
    return Transducer(("none", "want"), frozenset(("none", "got")), arcs)


def threat() -> Transducer:
    """States: intent seen or not (a clause begins as if it were), words left for the object, target just before."""
    arcs = {}
    for begun in ("begin", "idle", "intent"):
        for left in range(_THREAT_SCOPE + 1):
            for object_before in (False, True):
                for x in (*READ, AIMED):
                    out, now, words, before = x, "intent" if x == INTENT or begun == "intent" else "idle", max(0, left - 1), x == TARGET
                    if x in (OPEN, CLOSE):
                        now, words, before = begun, left, object_before
                    elif x == THREAT:
                        out, words = OTHER, _THREAT_SCOPE if begun != "idle" else 0
                    elif x == LAST_THREAT:
                        out, words = THREATENED if object_before else OTHER, 0
                    elif x == TARGET and left:
                        out, words = THREATENED, 0
                    arcs[(begun, left, object_before), x] = ((out, (), (now, words, before)),)
    return Transducer((("begin", 0, False),), frozenset(at for at, _ in arcs), arcs)


def negation() -> Transducer:
    """The state is the number of words left in the scope of a negation."""
    arcs = {}
    for left in range(_NEGATION_SCOPE + 1):
        for x in (*READ, AIMED, THREATENED):
            after = left if x in (OPEN, CLOSE) else _NEGATION_SCOPE if x == NEGATION else max(0, left - 1)
            arcs[left, x] = ((NEGATED if left and x in MATCHES else x, (), after),)
    return Transducer((0,), frozenset(range(_NEGATION_SCOPE + 1)), arcs)


def report() -> Transducer:
    """The state is whether a verb of saying has been read and whether a quotation is open."""
    arcs = {}
    for said in (False, True):
        for quoted in (False, True):
            for x in (*READ, AIMED, THREATENED, NEGATED):
                to = said or x == REPORT, x == OPEN or quoted and x != CLOSE
                arcs[(said, quoted), x] = ((REPORTED if (said or quoted) and x in MATCHES else x, (), to),)
    return Transducer(((False, False),), frozenset(at for at, _ in arcs), arcs)


def clause() -> Transducer:
    """One state; matches are written and weighted, all else becomes other."""
    weights = {x: (i,) for i, x in enumerate((INSULT, AIMED, STEM, THREATENED, NEGATED, REPORTED))}
    return Transducer((0,), frozenset((0,)), {(0, x): ((x if x in weights else OTHER, weights.get(x, ()), 0),) for x in range(REPORTED + 1)})


def cascade() -> list[Transducer]:
    return [target(), threat(), negation(), report(), clause()]


def machine() -> tuple[list[int], frozenset, list[list[tuple]]]:
    """The composed transducers: starts, finals and ``table[state][symbol] = ((weights, next state), ...)`` with numbered states."""
    whole, *rest = cascade()
    for part in rest:
        whole = compose(whole, part)
    states = sorted({at for at, _ in whole.arcs} | {to for made in whole.arcs.values() for _, _, to in made} | set(whole.starts), key=repr)
    number = {s: i for i, s in enumerate(states)}
    table = [[tuple((w, number[to]) for _, w, to in whole.arcs.get((s, x), ())) for x in READ] for s in states]
    return [number[s] for s in whole.starts], frozenset(number[s] for s in whole.finals), table


STARTS, FINALS, TABLE = machine()


@dataclass
class Grammar:
    stems: tuple[str, ...] = ()
    weights: np.ndarray = field(default_factory=lambda: DEFAULT_WEIGHTS)
    memo: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.lexicon: dict = {}
        for symbol, words in (*WORDS, (STEM, self.stems)):
            for word in words:
                node = self.lexicon
                for letter in word:
                    node = node.setdefault(letter, {})
                node["stem" if symbol == STEM else "word"] = symbol

    def symbol(self, word: str) -> int:
        """The lexicon transducer: one step per letter; a learned beginning is met on the way, a word at its end."""
        node, met = self.lexicon, OTHER
        for letter in _STRIP.sub("", word.lower()):
            node = node.get(letter)
            if node is None:
                return met
            met = node.get("stem", met)
        return node.get("word", met)

    def code(self, word: str) -> int:
        """The word's symbol, and whether it opens or closes a quotation."""
        return self.symbol(word) | (_OPENED if len(word) > 1 and word[0] in "\"“«" else 0) | (_CLOSED if word[-1] in "\"”»" else 0)

    def walk(self, symbols: Iterable[int]) -> tuple[int, ...]:
        """The weights that the best accepting path of a clause takes."""
        paths = [(s, ()) for s in STARTS]
        for x in symbols:
            paths = [(to, took + w if w else took) for at, took in paths for w, to in TABLE[at][x]]
        ends = [took for at, took in paths if at in FINALS]
        return ends[0] if len(ends) == 1 else max(ends, key=lambda took: sum(self.weights[list(took)]), default=())

    def outputs(self, text: str) -> np.ndarray:
        """How often each weighted arc is taken."""
        counts = np.zeros(len(OUTPUTS))
        words = text.split()
        memo = self.memo
        codes = list(map(memo.get, words))
        if None in codes:
            if len(memo) > MEMO:
                memo.clear()
            for w in set(words).difference(memo):
                memo[w] = self.code(w)
            codes = list(map(memo.__getitem__, words))
        hits = [i for i, c in enumerate(codes) if c and c & 15 in _SEEN]
        done = -1
        for i in hits:
            if i <= done:
                continue
            first, last = i, i
            while first and not ends_clause(words[first - 1]):
                first -= 1
            while last + 1 < len(words) and not ends_clause(words[last]):
                last += 1
            done = last
            for output in self.walk(symbols_of(codes[first:last + 1])):
                counts[output] += 1
        return counts

    def score(self, text: str) -> float:
        return float(sigmoid(features(self.outputs(text)) @ self.weights[:-1] + self.weights[-1]))


def symbols_of(codes: list[int]):
    for c in codes:
        if c & _OPENED:
            yield OPEN
        yield c & 15
        if c & _CLOSED:
            yield CLOSE


def ends_clause(word: str) -> bool:
    return word[-1] in ".!?;:" or word[-1] in "\"'”»)" and word[:-1].endswith((".", "!", "?"))


def features(counts: np.ndarray) -> np.ndarray:
    """Arcs up to three times each, and whether there is any that is neither negated nor reported."""
    return np.append(np.minimum(counts, 3.0), float(counts[:4].any()))


def learn_stems(rows: list[tuple[str, int]], known: Grammar, least: int = 4, share: float = 0.01, common: float = 0.08) -> tuple[str, ...]:
    """Word beginnings that cover toxic texts without a known insult and (nearly) no clean text.

    Chosen greedily by the toxic texts they newly cover, so words that merely come along in copies
    of a toxic text are not taken once the text is covered.  Beginnings that a ``common`` share of
    these texts hold and no clean text does are taken as well.
    """
    left = [text for text, y in rows if y == 1 and not known.outputs(text)[:4].any()]
    if not left:
        return ()
    least = max(least, int(share * len(left)))
    words = lambda text: set(_WORDS(text.lower()))
    cut: dict[str, list[str]] = {}

    def beginnings(word: str) -> list[str]:
        found = cut.get(word)
        if found is None:
            found = cut[word] = [word[:n] for n in range(4, min(8, len(word)) + 1)]
        return found

    held = [{b for w in words(text) for b in beginnings(w)} for text in left]
    support = Counter(b for bs in held for b in bs)
    candidates = {b for b, n in support.items() if n >= least}
    cut = {}
    clean: Counter[str] = Counter()
    touched: dict[str, tuple[str, ...]] = {}
    for text, y in rows:
        if y != 1:
            seen: set[str] = set()
            for w in words(text):
                hit = touched.get(w)
                if hit is None:
                    hit = touched[w] = tuple(w[:n] for n in range(4, min(8, len(w)) + 1) if w[:n] in candidates)
                if hit:
                    seen.update(hit)
            clean.update(seen)
    holders = {b: set() for b in candidates if clean[b] <= 0.01 * support[b]}
    for i, bs in enumerate(held):
        for b in bs & holders.keys():
            holders[b].add(i)
    chosen, uncovered = [], set(range(len(left)))
    heap = [(-len(h), -len(b), b) for b, h in holders.items()]
    heapq.heapify(heap)
    while heap:  # what a beginning newly covers only shrinks, so a stale top is put back with its present size
        size, length, best = heapq.heappop(heap)
        fresh = holders[best] & uncovered
        if len(fresh) < least:
            continue
        if len(fresh) < -size:
            heapq.heappush(heap, (-len(fresh), length, best))
            continue
        chosen.append(best)
        uncovered -= fresh
    for b in sorted(holders, key=lambda b: (-len(b), b)):
        if support[b] >= max(10, common * len(left)) and not clean[b] and not any(b.startswith(c) or c.startswith(b) and support[c] >= 0.9 * support[b] for c in chosen):
            chosen.append(b)
    return tuple(sorted(chosen))


def train(rows: list[tuple[bytes, int]]) -> Grammar:
    texts = [(t.decode("utf-8", "replace"), int(y)) for t, y in rows]
    if len({y for _, y in texts}) < 2:
        return Grammar()
    grammar = Grammar(learn_stems(texts, Grammar()))
    x = np.array([features(grammar.outputs(t)) for t, _ in texts])
    y = np.array([y for _, y in texts], float)
    weights = logistic(x, y, penalty=1e-4, prior=DEFAULT_WEIGHTS)
    return Grammar(grammar.stems, weights)


def with_score(df: DataFrame, grammar: Grammar, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the score of ``text``."""
    stems, weights = grammar.stems, grammar.weights

    def maker():
        own = Grammar(stems, weights)
        return lambda texts: [[own.score((t or b"").decode("utf-8", "replace")) for t in texts]]

    return annotate(df, text, [(name, T.DoubleType())], maker)


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Grammar:
    learn = docs.where(remainder(F.col("doc_id"), 3) != 1)
    return train(labelled_sample(learn, read_table(spark, sf_dir, "labels"), "toxic", TRAIN_DOCS))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = with_score(docs, fitted(spark, docs, sf_dir)).drop("text")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
