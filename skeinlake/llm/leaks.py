"""Evaluation passages inside training texts.

The evaluation items are turned into words and put into a generalised suffix automaton, the
smallest automaton that recognises every run of words of every item. Training texts are streamed
through it word by word while the length of the longest match is tracked, so each text is read
once however many items there are. Spans whose match reaches ``min_words`` are reported with the
items they belong to and can be removed.

The automaton is sent to all executors; items are split into automata of at most
``words_per_automaton`` words, which bounds what is sent (about 300 bytes a word), and the texts
are streamed through one after the other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.lookalikes import unified, unified_character

#: Maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(unified(text).lower())


@dataclass
class SuffixAutomaton:
    """States with their transitions, suffix links and longest lengths; state 0 is the start."""

    min_words: int
    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: For states that stand for runs of at least min_words: the state of their last min_words words.
    core: list[int] = field(default_factory=list)
    items: dict[int, list[int]] = field(default_factory=dict)

    def plain(self) -> tuple:
        """The fields in their order: numbers, lists and dictionaries, which any executor can read."""
        return self.min_words, self.next, self.link, self.length, self.core, self.items

    def _state(self, length: int, transitions: dict[str, int], link: int) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _fork(self, state: int, word: str, target: int) -> int:
        """A copy of ``target`` for the runs of it that end ``state`` plus ``word``."""
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state != -1 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def extend(self, last: int, word: str) -> int:
        """The state reached from ``last`` by ``word``, made if it doesn't exist."""
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._fork(last, word, target)
        new, state = self._state(self.length[last] + 1, {}, 0), last
        while state != -1 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state != -1:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._fork(state, word, target)
        return new

    def finish(self, texts: Iterable[tuple[int, list[str]]]) -> None:
        """Attach items to the states of their runs of exactly ``min_words`` words."""
        self.core = [-1] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            if self.length[state] >= self.min_words:
                up = self.link[state]
                self.core[state] = state if self.length[up] < self.min_words else self.core[up]
        held: dict[int, set[int]] = {}
        for item, tokens in texts:
            for state, length in self.matches(tokens):
                if length >= self.min_words:
                    held.setdefault(self.core[state], set()).add(item)
        self.items = {s: sorted(i) for s, i in held.items()}

    def matches(self, tokens: list[str]) -> Iterator[tuple[int, int]]:
        """After each word: the state and length of the longest run of an item that ends there."""
        state, length, transitions, link, longest = 0, 0, self.next, self.link, self.length
        for word in tokens:
            target = transitions[state].get(word)
            while target is None and state:
                state = link[state]
                length = longest[state]
                target = transitions[state].get(word)
            if target is not None:
                state, length = target, length + 1
            yield state, length


def build(texts: list[tuple[int, list[str]]], min_words: int) -> SuffixAutomaton:
    automaton = SuffixAutomaton(min_words)
    for _, tokens in texts:
        state = 0
        for word in tokens:
            state = automaton.extend(state, word)
    automaton.finish(texts)
    return automaton


def scan(automaton: SuffixAutomaton, tokens: list[str]) -> dict[int, list[tuple[int, int]]]:
    """Item -> spans (first word, one past the last) of the text that it shares with the item."""
    found: dict[int, list[tuple[int, int]]] = {}
    least, core, items = automaton.min_words, automaton.core, automaton.items
    for at, (state, length) in enumerate(automaton.matches(tokens)):
        if length >= least:
            for item in items.get(core[state], ()):
                spans = found.setdefault(item, [])
                start = at + 1 - least
                if spans and spans[-1][1] >= start:
                    spans[-1] = (spans[-1][0], at + 1)
                else:
                    spans.append((start, at + 1))
    return found


def _known(items: DataFrame, item_key: str, item_text: str) -> Iterator[tuple[int, str]]:
    """The different items in order, read partition by partition."""
    rows = items.select(item_key, item_text).where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).distinct()
    return ((r[0], r[1]) for r in rows.orderBy(item_key, item_text).toLocalIterator())


def _groups(items: Iterable[tuple[int, str]], words_per_automaton: int) -> Iterator[list[tuple[int, list[str]]]]:
    group, size = [], 0
    for item, text in items:
        tokens = words(text)
        if group and size + len(tokens) > words_per_automaton:
            yield group
            group, size = [], 0
        group.append((item, tokens))
        size += len(tokens)
    if group:
        yield group


LEAKS = "id long, item long, words int, longest int, coverage double"


def leaks(documents: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, min_words: int = 12, min_coverage: float = 1.1, words_per_automaton: int = 1_000_000) -> DataFrame:
    """id, item, words, longest, coverage: texts that share a run of at least ``min_words`` words with an item.

    ``words`` counts the text's words inside shared spans, ``longest`` the longest span, ``coverage``
    the spans' part of the item. Where ``min_coverage`` is at most 1, an item that is shorter than
    ``min_words`` counts once that part of it is found in one run. Null texts and items, and texts
    without words, share nothing. The driver reads the items, of which it holds those of one
    automaton at a time, and never the texts.
    """
    spark = documents.sparkSession
    known = _known(items, item_key, item_text)
    texts = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    out = spark.createDataFrame([], LEAKS)
    for group in _groups(known, words_per_automaton):
        for least, part in _by_least(group, min_words, min_coverage):
            sizes = {}
            for item, tokens in part:
                sizes[item] = max(len(tokens), sizes.get(item, 1))
            shared = spark.sparkContext.broadcast((build(part, least).plain(), sizes))
            out = out.unionByName(texts.mapInPandas(_scanner(shared), LEAKS))
    return out


def _by_least(group: list[tuple[int, list[str]]], min_words: int, min_coverage: float) -> list[tuple[int, list[tuple[int, list[str]]]]]:
    """Items by the number of words that must be shared: fewer for short items if coverage counts."""
    by: dict[int, list[tuple[int, list[str]]]] = {}
    for item, tokens in group:
        if len(tokens) >= min_words:
            by.setdefault(min_words, []).append((item, tokens))
        elif min_coverage <= 1 and tokens:
            by.setdefault(max(1, -int(-len(tokens) * min_coverage // 1)), []).append((item, tokens))
    return sorted(by.items())


def _scanner(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields, sizes = shared.value
        automaton = SuffixAutomaton(*fields)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"]):
                for item, spans in scan(automaton, words(text)).items():
                    lengths = [end - start for start, end in spans]
                    rows.append((doc, item, sum(lengths), max(lengths), min(1.0, max(lengths) / sizes[item])))
            yield pd.DataFrame(rows, columns=["id", "item", "words", "longest", "coverage"])

    return run


def _origins(text: str) -> tuple[list[int], list[int]]:
    """For each character of the lower-case unified form: where the part of ``text`` it comes from starts and ends.

    A part is the least that can be unified by itself: a character with the marks that compose
    with it and the characters after it that are mapped to nothing.
    """
    parts: list[tuple[int, str]] = []
    for i, c in enumerate(text):
        mapped = c if c.isascii() else unified_character(c)
        if parts and not c.isascii():
            start, before = parts[-1]
            inner = not mapped or unicodedata.combining(unicodedata.normalize("NFD", mapped)[0])
            if inner or _nfc(before + mapped) != _nfc(before) + _nfc(mapped):
                parts[-1] = (start, before + mapped)
                continue
        parts.append((i, mapped))
    starts, ends = [], []
    for (start, mapped), end in zip(parts, [*(start for start, _ in parts[1:]), len(text)]):
        size = len(_nfc(mapped).lower())
        starts += [start] * size
        ends += [end] * size
    return starts, ends


def _nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def _without(text: str, drop: set[int]) -> str:
    """The text without the words at these places and what stands between each and the word before it."""
    at = [m.span() for m in WORD.finditer(unified(text).lower())]
    starts, ends = _origins(text)
    kept, done, before = [], 0, 0
    for i, (a, b) in enumerate(at):
        end = ends[b - 1]
        if i in drop:
            kept.append(text[done : max(done, min(before, starts[a]))])
            done = end
        before = end
    return "".join(kept) + text[done:]


def _dropped(automata: list[SuffixAutomaton], tokens: list[str]) -> set[int]:
    return {i for automaton in automata for own in scan(automaton, tokens).values() for s, e in own for i in range(s, e)}


def _cutter(shared):
    """Cuts spans in one pass, with all automata in one broadcast."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = [SuffixAutomaton(*fields) for fields in shared.value]
        for batch in batches:
            drops = [set() if t is None else _dropped(automata, words(t)) for t in batch["text"]]
            kept = [_without(t, d) if d else t for t, d in zip(batch["text"], drops)]
            yield pd.DataFrame({"id": batch["id"], "text": kept, "removed_words": [len(d) for d in drops]})

    return run


def _finder(shared):
    """Digest of each text that has words to drop, and their places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = [SuffixAutomaton(*fields) for fields in shared.value]
        for batch in batches:
            rows = [(k, sorted(d)) for k, t in zip(batch["digest"], batch["text"]) if (d := _dropped(automata, words(t)))]
            yield pd.DataFrame(rows, columns=["digest", "places"])

    return run


def _cut_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        drops = [set() if p is None else {int(i) for i in p} for p in batch["places"]]
        kept = [_without(t, d) if d else t for t, d in zip(batch["text"], drops)]
        yield pd.DataFrame({"id": batch["id"], "text": kept, "removed_words": [len(d) for d in drops]})


REMOVED = "id long, text string, removed_words int"


def remove_spans(documents: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, min_words: int = 12, min_coverage: float = 1.1, words_per_automaton: int = 1_000_000) -> DataFrame:
    """key, text, removed_words: every text, without the words that it shares with items in the runs that ``leaks`` counts.

    Texts without such runs stay as they are; in others what is kept is as in the original. A null
    text stays null. Where the items need several broadcasts, texts are searched once for each and
    the places found are joined to them by digest.
    """
    spark = documents.sparkSession
    known = _known(items, item_key, item_text)
    texts = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sent = [spark.sparkContext.broadcast([build(part, least).plain() for least, part in _by_least(g, min_words, min_coverage)]) for g in _groups(known, words_per_automaton)]
    if len(sent) <= 1:
        out = texts.mapInPandas(_cutter(sent[0] if sent else spark.sparkContext.broadcast([])), REMOVED)
    else:
        texts = texts.withColumn("digest", F.sha2("text", 256))
        searched = texts.where("text is not null").select("digest", "text")
        found = None
        for shared in sent:
            one = searched.mapInPandas(_finder(shared), "digest string, places array<int>")
            found = one if found is None else found.unionByName(one)
        places = found.groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"))
        out = texts.join(places, "digest", "left").select("id", "text", "places").mapInPandas(_cut_places, REMOVED)
    return out.withColumnsRenamed({"id": key, "text": text})
