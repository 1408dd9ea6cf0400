"""A BPE vocabulary compiled into a deterministic automaton.

Successive merge gadgets. Start with one state that loops on every symbol. The merge
``u v -> w`` of rank i redirects all arcs labelled u to a copy of their target from which v
is gone, and gives every state that had u an arc labelled w to where v led. Afterwards the
target of an arc depends on its label alone, so a state is named by the token last read, and

* its missing arcs are the right operands of the merges whose left operand is that token, or,
  on the right spine of the token, one whose gadget came before the token that hides it;
* an arc w is missing too where its left operand was missing when w's gadget came.

So the arc ``y`` leaves state ``x`` unless some merge (a, b) with a on the right spine of x
and b on the left spine of y came before the gadgets that cover a and b (``allowed``).

That automaton reads tokens and accepts just the correct tokenizations; each prefix of a word
has exactly one. To read symbols it is made deterministic over the trie of arc labels: a state
is the set of open (token state, trie place) pairs; reading a symbol moves each pair on, and
the one label that is complete and allowed there opens the next. States and transitions are
tabulated as texts need them. A word is encoded by following transitions and then reading the
labels backwards; ids are decoded by emitting the labels.
"""

from __future__ import annotations

import json

from sablewatch.llm.pretokens import byte_symbols

#: Table entries after which the tables start anew; bounds a worker's memory, not the results.
TABLE_LIMIT = 400_000
_NEVER = 1 << 60


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "") -> None:
        self.labels = {i: t for t, i in vocab.items()}
        self.suffix = suffix
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for i, pair in enumerate(merges):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(i, vocab[u], vocab[v], vocab[u + v])
        self.length = {}
        self._trie: list[dict[int, int]] = [{}]
        self._token = [-1]
        self._plant(vocab, merges)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _gadget(self, i: int, u: int, v: int, w: int) -> None:
        self.rank.setdefault((u, v), i)
        if w not in self.born:
            self.left[w], self.right[w], self.born[w] = u, v, i

    def _plant(self, vocab: dict[str, int], merges: list) -> None:
        """The trie of labels over symbols 0-255 (a byte) and 256-511 (a word's last byte).

        Only what merges can make from single symbols is an arc.
        """
        spell: dict[int, tuple[int, ...]] = {}
        for b, s in enumerate(byte_symbols()):
            if s in vocab:
                spell[vocab[s]] = (b,)
            if self.suffix and s + self.suffix in vocab:
                spell[vocab[s + self.suffix]] = (256 + b,)
        for w in sorted(self.born, key=self.born.get):
            u, v = self.left[w], self.right[w]
            if u in spell and v in spell and self.allowed_then(u, v, self.born[w]):
                spell.setdefault(w, spell[u] + spell[v])
        for token, symbols in spell.items():
            node = 0
            for s in symbols:
                nxt = self._trie[node].get(s)
                if nxt is None:
                    nxt = self._trie[node][s] = len(self._trie)
                    self._trie.append({})
                    self._token.append(-1)
                node = nxt
            self._token[node] = token
            self.length[token] = len(symbols)

    def allowed_then(self, x: int, y: int, now: int) -> bool:
        """Whether arc y leaves the state of x in the automaton of the first ``now`` gadgets."""
        a, above_a = x, now
        while True:
            b, above_b = y, now
            while True:
                r = self.rank.get((a, b))
                if r is not None and r < above_a and r <= above_b and r < now:
                    return False
                if b not in self.left:
                    break
                above_b, b = self.born[b], self.left[b]
            if a not in self.right:
                return True
            above_a, a = self.born[a], self.right[a]

    def allowed(self, x: int, y: int) -> bool:
        known = self._pairs.get((x, y))
        if known is None:
            if len(self._pairs) > TABLE_LIMIT:
                self._pairs.clear()
            known = self._pairs[x, y] = x < 0 or self.allowed_then(x, y, _NEVER)
        return known

    def _reset(self) -> None:
        self._states = {((-1, 0),): 0}
        self._open = [((-1, 0),)]
        self._next: dict[int, tuple[int, int]] = {}

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        moved, label = [], -1
        for last, node in self._open[state]:
            node = self._trie[node].get(symbol)
            if node is None:
                continue
            token = self._token[node]
            if token >= 0 and label < 0 and self.allowed(last, token):
                label = token
            if self._trie[node]:
                moved.append((last, node))
        if label < 0:
            raise ValueError(f"no token covers symbol {symbol}")
        moved.append((label, 0))
        key = tuple(moved)
        to = self._states.get(key)
        if to is None:
            to = self._states[key] = len(self._open)
            self._open.append(key)
        out = self._next[state << 9 | symbol] = (to, label)
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if not word:
            return []
        if len(self._next) > TABLE_LIMIT:
            self._reset()
        state, labels, table, step = 0, [], self._next, self._step
        for b in word[:-1]:
            state, label = table.get(state << 9 | b) or step(state, b)
            labels.append(label)
        labels.append((table.get(at := state << 9 | word[-1] | (256 if self.suffix else 0)) or step(state, at & 511))[1])
        ids, end = [], len(labels)
        while end:
            ids.append(labels[end - 1])
            end -= self.length[ids[-1]]
        ids.reverse()
        return ids

    def decode(self, ids) -> list[str]:
        """Labels of the arcs."""
        labels = self.labels
        return [labels[i] for i in ids]


def compiled(tokenizer_json: str) -> tuple[Automaton, dict[str, int]]:
    """The automaton of a tokenizer file's text, and its added tokens."""
    spec = json.loads(tokenizer_json)
    model = spec["model"]
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return Automaton(model["vocab"], model["merges"], model.get("end_of_word_suffix") or ""), added
