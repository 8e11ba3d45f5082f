"""Containment guard on streamed text: a run of sealed words is noticed before its last word can be shown.

Words are folded as ``text.fold_words`` folds them (vowel marks dropped, letters folded, punctuation
and blanks between words), so a passage that is retyped, with or without marks, is caught. The state of a session
is an automaton's: the last words that are complete, the letters of the one that isn't, and the text
that is held back. A delta costs work in proportion to itself, and the state doesn't grow with the
session; the outcome is that of rescanning all text so far after every delta.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import text as T

HOLDBACK, RUN = 96, 4
REDIRECT = "[redirect]"
#: Sealed runs of one guard; they go to every task.
MAX_RUNS = 1_000_000
_FOLD = dict(zip(T.FOLD_FROM, T.FOLD_TO, strict=True))


def _between(ranges: str, ch: str) -> bool:
    at = 0
    while at < len(ranges):
        if at + 2 < len(ranges) and ranges[at + 1] == "-":
            if ranges[at] <= ch <= ranges[at + 2]:
                return True
            at += 3
        elif ranges[at] == ch:
            return True
        else:
            at += 1
    return False


@cache
def folded(ch: str) -> str:
    """What becomes of a character: nothing, a blank that separates words, or letters."""
    out = []
    for c in ch.lower():
        if _between(T.MARKS_LOOSE + T.TATWEEL + T.ORNATE, c):
            continue
        out.append(" " if unicodedata.category(c)[0] in "PSZ" or c in T.CONTROL_GAPS else _FOLD.get(c, c))
    return "".join(out)


def words_of(text: str) -> list[str]:
    """Python's twin of ``text.fold_words``."""
    return "".join(map(folded, text)).split(" ") if text else []


class Held(NamedTuple):
    """State of a session: complete words before the current one (joined by a blank), letters of that one, text not shown yet, whether any was shown, whether it is over."""

    words: str = ""
    letters: str = ""
    pending: str = ""
    shown: bool = False
    redacted: bool = False


class Guard:
    def __init__(self, corpus: Iterable[str], run: int = RUN, holdback: int = HOLDBACK, redirect: str = REDIRECT):
        self.run, self.holdback, self.redirect = run, holdback, redirect
        self.runs: set[str] = set()
        for text in corpus:
            words = [w for w in words_of(text) if w]
            self.runs.update(" ".join(words[i : i + run]) for i in range(len(words) - run + 1))
            if len(self.runs) > MAX_RUNS:
                raise ValueError(f"the sealed corpus has more than {MAX_RUNS} runs: guard each lesson by its own passages")

    def _sealed(self, words: str, last: str) -> bool:
        return bool(last) and (f"{words} {last}" if words else last) in self.runs

    def _pushed(self, words: str, word: str) -> str:
        """The last ``run - 1`` words."""
        return " ".join([*words.split(), word][1 - self.run :]) if self.run > 1 else ""

    def step(self, held: Held, delta: str | None, end: bool) -> tuple[Held, str | None, bool]:
        """One delta: (state, text to show or null, whether that is the redirect). The last ``holdback`` characters wait for the end."""
        if held.redacted:
            return held, None, False
        words, letters, tripped = held.words, held.letters, False
        for ch in delta or "":
            for c in folded(ch):
                if c != " ":
                    letters += c
                elif letters:
                    tripped = tripped or self._sealed(words, letters)
                    words, letters = self._pushed(words, letters), ""
        if tripped or self._sealed(words, letters):
            out = ("\n\n" if held.shown else "") + self.redirect
            return Held(shown=True, redacted=True), out, True
        pending = held.pending + (delta or "")
        ready = len(pending) if end else max(0, len(pending) - self.holdback)
        out = pending[:ready]
        return Held(words, letters, pending[ready:], held.shown or bool(out), False), out or None, False


def guard_stream(deltas: DataFrame, corpus: list[str], run: int = RUN, holdback: int = HOLDBACK, redirect: str = REDIRECT) -> DataFrame:
    """Deltas (session, position, delta, is_end) against sealed texts: (session, position, text, redacted). It fails closed, with a holdback."""
    guard = Guard(corpus, run, holdback, redirect)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        held = Held(*state.get) if state.exists else Held()
        out = []
        for row in pd.concat(list(frames)).sort_values("position").itertuples():
            held, text, red = guard.step(held, row.delta, bool(row.is_end))
            if text is not None:
                out.append((key[0], row.position, text, red))
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=["session", "position", "text", "redacted"]).astype({"position": "int64", "redacted": "bool"})

    return deltas.groupBy("session").applyInPandasWithState(advance, "session string, position long, text string, redacted boolean", "words string, letters string, pending string, shown boolean, redacted boolean", "append", GroupStateTimeout.NoTimeout)
