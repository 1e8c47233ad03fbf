"""k-way merge of sorted runs by a tree of losers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

_END = (1,)


def merge(runs: Sequence[Sequence[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, position) of every entry of ``runs``, each sorted, in global order.

    Inner nodes keep the loser of the match below them, so each step replays
    one path from leaf to root: log2(k) comparisons.  Equal entries come in the
    order of their runs.
    """
    k = len(runs)
    if not k:
        return
    at = [0] * k
    heads = [(0, *r[0], i) if len(r) else _END for i, r in enumerate(runs)]
    losers: list[int | None] = [None] * k
    champion = 0
    for i in range(k):
        winner, node = i, (i + k) // 2
        while node:
            other = losers[node]
            if other is None:
                losers[node] = winner
                break
            if heads[other] < heads[winner]:
                losers[node], winner = winner, other
            node //= 2
        else:
            champion = winner
    while heads[champion] is not _END:
        yield champion, at[champion]
        at[champion] += 1
        run = runs[champion]
        heads[champion] = (0, *run[at[champion]], champion) if at[champion] < len(run) else _END
        winner, node = champion, (champion + k) // 2
        while node:
            if heads[losers[node]] < heads[winner]:
                losers[node], winner = winner, losers[node]
            node //= 2
        champion = winner
