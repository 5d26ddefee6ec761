"""Byte-pair encoding of a word as a deterministic transducer that emits token counts.

A sequence of tokens is the encoding of its text exactly if every two neighbours are the encoding of theirs. So the last
token after each prefix of a word is the one suffix of it that is a token and agrees with the last token of what stands
before; the number of tokens is one more than there. Nothing further back than the longest prefix of any token can be
part of a later token. A state therefore holds that stretch of the word, the last token at each place in it, and the
counts there relative to its first place. Reading a symbol leads to one next state and emits the change of the count.
The last symbol of a word is another one (it carries the end mark), so each state has a second table for it.

States and transitions are compiled when they are first reached, from the merges alone. Their number is bounded by the
merges; who keeps no state may `reset` them when there are more than `most`.
"""

from __future__ import annotations

State = tuple[str, tuple, tuple]
START: State = ("", (None,), (0,))


class WordTransducer:
    def __init__(self, merges: list[tuple[str, str]], end: str, most: int = 120_000):
        self.rank = {m: i for i, m in enumerate(merges)}
        self.end, self.most = end, most
        made = {a + b for a, b in merges}
        self.tokens = {t for t in made if self.encode(self.symbols(t)) == [t]}
        self.openings = {t[:i] for t in map(self.plain, self.tokens) for i in range(1, len(t))}
        self.agreed: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.number: dict[State, int] = {START: 0}
        self.states: list[State] = [START]
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.last: list[dict[str, int]] = [{}]

    def plain(self, token: str) -> str:
        return token.removesuffix(self.end)

    def symbols(self, token: str) -> list[str]:
        body = self.plain(token)
        return [*body[:-1], body[-1] + token[len(body) :]]

    def encode(self, symbols: list[str]) -> list[str]:
        """The merges in order of rank, leftmost first."""
        s = list(symbols)
        while len(s) > 1:
            best, i = min((self.rank.get(p, len(self.rank)), k) for k, p in enumerate(zip(s, s[1:], strict=False)))
            if best == len(self.rank):
                break
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def agree(self, a: str, b: str) -> bool:
        if (found := self.agreed.get((a, b))) is None:
            if len(self.agreed) > 4 * self.most:
                self.agreed.clear()
            found = self.agreed[a, b] = self.encode([*a, *self.symbols(b)]) == [a, b]
        return found

    def token_after(self, state: State, symbol: str) -> tuple[str, int]:
        """The token that ends with the symbol, and where in the state's stretch it begins."""
        stretch, last, _ = state
        for k in range(len(last)):
            token = stretch[k:] + symbol
            if (k == len(stretch) or token in self.tokens) and (last[k] is None or self.agree(last[k], token)):
                return token, k
        raise AssertionError((state, symbol))

    def step(self, at: int, symbol: str) -> tuple[int, int]:
        """Next state and emitted count."""
        if (found := self.next[at].get(symbol)) is None:
            state = self.states[at]
            token, k = self.token_after(state, symbol)
            count = state[2][k] + 1
            stretch, last, counts = state[0] + symbol, (*state[1], token), (*state[2], count)
            m = 0
            while m < len(stretch) and stretch[m:] not in self.openings:
                m += 1
            new = (stretch[m:], last[m:], tuple(c - counts[m] for c in counts[m:]))
            if new not in self.number:
                self.number[new] = len(self.states)
                self.states.append(new)
                self.next.append({})
                self.last.append({})
            found = self.next[at][symbol] = (self.number[new], count - state[2][-1])
        return found

    def finish(self, at: int, symbol: str) -> int:
        """The count emitted for the last symbol."""
        if (found := self.last[at].get(symbol)) is None:
            state = self.states[at]
            found = self.last[at][symbol] = state[2][self.token_after(state, symbol + self.end)[1]] + 1 - state[2][-1]
        return found

    def count(self, word: str) -> int:
        """Tokens of a word given as the characters that stand for its bytes."""
        at, total, step, follow = 0, 0, self.step, self.next
        for c in word[:-1]:
            at, emitted = follow[at].get(c) or step(at, c)
            total += emitted
        return total + self.finish(at, word[-1])
