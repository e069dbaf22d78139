"""Company names in texts: shorter forms of a name, and masking of names and symbols."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.textops import NOT_SYMBOLS

# Words that end a company's name, without points and in lower case.
ENDINGS = frozenset(("inc", "incorporated", "corp", "corporation", "ltd", "limited", "holdings", "co", "company", "plc", "nv", "sa", "lp", "llc"))
EDGE = " ,."
WORD = re.compile(r"\w+")


def is_ending(word: str) -> bool:
    return word.strip(EDGE).replace(".", "").lower() in ENDINGS


def bare_name(name: str | None) -> str:
    """A registered name without the span of years behind a former one and without the tag of a state."""
    name = (name or "").strip()
    head, paren, span = name.rpartition("(")
    if paren and span.endswith(")") and span[:4].isdigit() and ".." in span:
        name = head.rstrip()
    head, slash, state = name.rstrip("/").rpartition("/")
    if slash and 2 <= len(state) <= 3 and state.isalpha() and state.isupper():
        name = head
    return name.strip(EDGE)


def name_variants(names: list[str]) -> list[str]:
    """Each name and what is left of it as endings go one by one, the longest first; single letters aren't names."""
    found: dict[str, None] = {}
    for name in map(bare_name, names):
        words = name.replace(",", ", ").split()
        last = len(words)
        while last and is_ending(words[last - 1]):
            last -= 1
        # The whole name as it is written, then each cut.
        for n in (name, *(" ".join(words[:k]).replace(" ,", ",").strip(EDGE) for k in range(len(words) - 1, max(last, 1) - 1, -1))):
            if len(n) >= 2:
                found[n] = None
    return sorted(found, key=lambda n: (-len(n), n))


class Phrases:
    """Phrases by their first word: words and what stands between them, so that a text is scanned once, word by word."""

    def __init__(self, phrases: list[str], fold: bool) -> None:
        self.fold, self.by_first = fold, defaultdict(list)
        for p in phrases:
            words = list(WORD.finditer(p))
            if words and words[0].start() == 0:
                gaps = [self._gap(p[a.end() : b.start()]) for a, b in zip(words, words[1:], strict=False)]
                self.by_first[self._word(words[0].group())].append(([self._word(w.group()) for w in words], gaps, p[words[-1].end() :]))

    def _word(self, w: str) -> str:
        return w.lower() if self.fold else w

    @staticmethod
    def _gap(s: str) -> str:
        """Any white space counts as one blank."""
        return re.sub(r"\s+", " ", s)

    def match(self, text: str, words: list[re.Match], k: int) -> tuple[int, int] | None:
        """(end, next word) of the first listed phrase that starts at word k."""
        for want, gaps, tail in self.by_first.get(self._word(words[k].group()), ()):
            n = len(want)
            if k + n > len(words) or any(self._word(words[k + i].group()) != want[i] for i in range(1, n)):
                continue
            if any(self._gap(text[words[k + i].end() : words[k + i + 1].start()]) != gaps[i] for i in range(n - 1)):
                continue
            end = words[k + n - 1].end()
            if text.startswith(tail, end):
                return end + len(tail), k + n
        return None


def _masked(text: str, phrases: Phrases, put: str, opens, endings: bool) -> str:
    words, out, at, k = list(WORD.finditer(text)), [], 0, 0
    while k < len(words):
        found = phrases.match(text, words, k) if opens(words[k].group()) else None
        if found is None:
            k += 1
            continue
        out += (text[at : words[k].start()], put)
        at, k = found
        while endings:  # ", Inc." and the like that follow go too
            rest = text[at:]
            gap = len(rest) - len(rest.lstrip(",").lstrip()) if rest[:1] in (",", "") else len(rest) - len(rest.lstrip())
            token = rest[gap:].split(None, 1)[0] if rest[gap:] else ""
            core = token.rstrip(",;:)\"'”’")
            if not gap or rest[:gap] == "," or not is_ending(core):
                break
            at += gap + len(core)
        while k < len(words) and words[k].start() < at:
            k += 1
    return "".join(out) + text[at:]


def masked(text: str, names: list[str], symbols: list[str], put: str = "the Company") -> str:
    """text with the names' variants (in any case, but with a capital or digit first, and endings behind them) and the
    symbols (as written, two letters at least, no common words) replaced."""
    forms = Phrases(name_variants(names), fold=True)
    text = _masked(text, forms, put, lambda w: w[0].isascii() and (w[0].isupper() or w[0].isdigit()), True) if forms.by_first else text
    known = Phrases(sorted((s for s in set(symbols) if len(s) >= 2 and s.upper() not in NOT_SYMBOLS), key=lambda s: (-len(s), s)), fold=False)
    return _masked(text, known, put, lambda w: True, False) if known.by_first else text


def anonymize(d: DataFrame, text: str = "text", names: str = "names", tickers: str = "tickers") -> DataFrame:
    """d with each row's own names (array) and tickers (array) masked in text; null texts become empty.

    Names differ by row, and Spark has no replacement by row-wise phrase lists, so a vectorised function does it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = lambda x: [] if x is None else [v for v in x if v]
        for b in batches:
            b[text] = [masked(t or "", given(n), given(k)) for t, n, k in zip(b[text], b[names], b[tickers], strict=True)]
            yield b

    return d.mapInPandas(run, d.schema)
