"""Probabilistic automata by state merging (ALERGIA): a prefix tree whose statistically compatible states are merged."""

from __future__ import annotations

import math


class Automaton:
    """counts[state]: passes, ends, and next state and count by character."""

    def __init__(self, words: list[str]):
        self.ends: list[int] = [0]
        self.next: list[dict[str, list[int]]] = [{}]
        for word in words:
            state = 0
            for c in word:
                edge = self.next[state].get(c)
                if edge is None:
                    edge = self.next[state][c] = [len(self.ends), 0]
                    self.ends.append(0)
                    self.next.append({})
                edge[1] += 1
                state = edge[0]
            self.ends[state] += 1

    def passes(self, state: int) -> int:
        return self.ends[state] + sum(n for _, n in self.next[state].values())

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether ends and moves of two states, and of those that they lead to, agree within Hoeffding bounds."""
        spread = math.sqrt(math.log(2 / alpha) / 2)
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.passes(a), self.passes(b)
            if not na or not nb:
                continue
            bound = spread * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.ends[a] / na - self.ends[b] / nb) > bound:
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if abs((x[1] if x else 0) / na - (y[1] if y else 0) / nb) > bound:
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Adds the counts of a subtree of the prefix tree to a state."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, (target, n) in self.next[b].items():
                edge = self.next[a].get(c)
                if edge is None:
                    self.next[a][c] = [target, n]
                else:
                    edge[1] += n
                    if edge[0] != target:
                        todo.append((edge[0], target))

    def merged(self, alpha: float = 0.05) -> Automaton:
        """Merges from the root outwards: each state on the border joins the first kept state that it agrees with, or is kept."""
        kept, done = [0], {0}
        while True:
            border = [(s, c) for s in kept for c, (t, _) in sorted(self.next[s].items()) if t not in done]
            if not border:
                return self
            state, c = border[0]
            target = self.next[state][c][0]
            for k in kept:
                if self.compatible(k, target, alpha):
                    self.next[state][c][0] = k
                    self.fold(k, target)
                    break
            else:
                kept.append(target)
                done.add(target)

    def table(self) -> list[tuple[float, dict[str, tuple[int, float]]]]:
        """For each reachable state the log probability to end, and of each move with its target."""
        number, order = {0: 0}, [0]
        for s in order:
            for t, _ in self.next[s].values():
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
        out = []
        for s in order:
            n = self.passes(s) + 1.0
            out.append((math.log((self.ends[s] + 0.5) / n), {c: (number[t], math.log(k / n)) for c, (t, k) in self.next[s].items()}))
        return out


def likelihood(table: list[tuple[float, dict[str, tuple[int, float]]]], word: str, unseen: float = -12.0) -> float:
    """Mean log probability per character; a move that was never seen costs ``unseen`` and stays."""
    state, total = 0, 0.0
    for c in word:
        target, p = table[state][1].get(c, (state, unseen))
        total += p
        state = target
    return (total + table[state][0]) / (len(word) + 1)


class Lengths:
    """Log probability of a length: those of the words seen, each spread to its neighbours, a tenth a step."""

    def __init__(self, words: list[str], spread: float = 0.1):
        self.spread, self.seen = spread, {n: 0 for n in map(len, words)}
        for word in words:
            self.seen[len(word)] += 1 / len(words)
        self.known: dict[int, float] = {}

    def likelihood(self, length: int) -> float:
        found = self.known.get(length)
        if found is None:
            share = sum(p * self.spread ** abs(length - n) for n, p in self.seen.items()) * (1 - self.spread) / (1 + self.spread)
            found = self.known[length] = math.log(max(share, 1e-300))
        return found


class WordModel:
    """Mean log probability per character of words under their trigrams, backed off to bigrams, single characters and a base rate.

    The base rate, which alone stands without any words, gives 90% to the small letters and the rest to the other characters
    of candidates.
    """

    LETTERS = 0.9
    #: Characters of candidates: letters, digits, six marks, and the end.
    ALPHABET = 26 + 26 + 10 + 6 + 1

    def __init__(self, words: dict[str, int], weight: float = 4.0):
        self.counts: dict[str, float] = {}
        self.weight, self.total = weight, 0
        for word, n in words.items():
            line = f"\n\n{word}\n"
            for i in range(2, len(line)):
                self.add(line[i - 2 : i + 1], n)

    @classmethod
    def of_trigrams(cls, counts: dict[str, float], weight: float = 4.0) -> WordModel:
        """The model of words by their trigrams, two line ends before a word and one after it; there are at most ``ALPHABET`` cubed."""
        out = cls({}, weight)
        for gram, n in sorted(counts.items()):
            out.add(gram, n)
        return out

    def add(self, gram: str, n: float) -> None:
        self.total += n
        for part in (gram[2], gram[1:], gram[1] + "\0", gram, gram[:2] + "\0"):
            self.counts[part] = self.counts.get(part, 0) + n

    def base(self, c: str) -> float:
        return self.LETTERS / 26 if "a" <= c <= "z" else (1 - self.LETTERS) / (self.ALPHABET - 26)

    def likelihood(self, word: str) -> float:
        line, sum_ = f"\n\n{word}\n", 0.0
        n, k, size = self.counts.get, self.weight, self.ALPHABET
        for i in range(2, len(line)):
            p = (n(line[i], 0) + size * self.base(line[i])) / (self.total + size)
            p = (n(line[i - 1 : i + 1], 0) + k * p) / (n(line[i - 1] + "\0", 0) + k)
            p = (n(line[i - 2 : i + 1], 0) + k * p) / (n(line[i - 2 : i] + "\0", 0) + k)
            sum_ += math.log(p)
        return sum_ / (len(word) + 1)
