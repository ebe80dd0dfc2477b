"""Minimised acceptors of word lists, composed with a one-edit transducer and with each other."""

from __future__ import annotations

from collections.abc import Iterator


class Acceptors:
    """Minimal deterministic acceptors. States are numbers, and equal states are one, also those
    of different acceptors, so that what two states have in common is worked out once."""

    def __init__(self):
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self._known: dict[tuple, int] = {}
        self._common: dict[tuple[int, int], list[str]] = {}

    def accept(self, words: list[str]) -> int:
        """The first state of the acceptor of sorted distinct words."""
        # The states of the last word, which may still get arcs: [final, arcs].
        path: list[list] = [[False, {}]]
        last = ""
        for word in words:
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            self._close(path, last, same)
            path += [[False, {}] for _ in word[same:]]
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        return self._numbered(path[0])

    def _numbered(self, state: list) -> int:
        key = (state[0], tuple(state[1].items()))
        number = self._known.get(key)
        if number is None:
            number = self._known[key] = len(self.final)
            self.final.append(state[0])
            self.arcs.append(state[1])
        return number

    def _close(self, path: list, last: str, keep: int) -> None:
        """The states behind the first `keep` symbols get no more arcs."""
        while len(path) - 1 > keep:
            state = path.pop()
            path[-1][1][last[len(path) - 1]] = self._numbered(state)

    def common(self, p: int, q: int) -> list[str]:
        """The words that both states accept."""
        if p > q:
            p, q = q, p
        found = self._common.get((p, q))
        if found is None:
            found = [""] if self.final[p] and self.final[q] else []
            few, many = self.arcs[p], self.arcs[q]
            if len(few) > len(many):
                few, many = many, few
            for c, to in few.items():
                other = many.get(c)
                if other is not None:
                    found += [c + rest for rest in self.common(to, other)]
            self._common[p, q] = found
        return found

    def replaced(self, start: int) -> Iterator[tuple[str, str]]:
        """The pairs of words of one acceptor that differ by one replaced code point, each once.

        Before the edit both words are in one state; after it they are in two, and what is left
        are the words that both states accept.
        """
        ahead = [("", start)]
        while ahead:
            prefix, state = ahead.pop()
            before: list[tuple[str, int]] = []
            for c, to in self.arcs[state].items():
                ahead.append((prefix + c, to))
                for d, other in before:
                    for rest in self.common(to, other):
                        yield prefix + c + rest, prefix + d + rest
                before.append((c, to))

    def deleted(self, longer: int, shorter: int) -> Iterator[tuple[str, str]]:
        """(word of the first, word of the second) that differ by one code point that the second
        lacks. Of equal code points the last one counts as lacking, so that a pair is found once."""
        ahead = [("", longer, shorter)]
        while ahead:
            prefix, p, q = ahead.pop()
            after = self.arcs[q]
            for c, to in self.arcs[p].items():
                for rest in self.common(to, q):
                    if not rest.startswith(c):
                        yield prefix + c + rest, prefix + rest
                if c in after:
                    ahead.append((prefix + c, to, after[c]))
