"""Expectation-maximisation over counts of vote patterns, on the driver: its work depends on the number of patterns, not of rows."""

from __future__ import annotations

import math

import numpy as np

VALUES = (-1, 1)


def reliabilities(counts: list[tuple[tuple[int, ...], float]], rounds: int = 100, prior: float = 0.5, against: float = 1.5, false_alarm: float = 1.0) -> tuple[float, list[dict[tuple[int, int], float]], dict[tuple[int, ...], float]]:
    """(share of positives, per labeller P(vote | class, it votes), P(positive | pattern)) of labellers that err independently.

    Not to vote says nothing.

    ``counts``: (votes of all labellers, each -1, 0 or 1; number of rows).
    Starts from the majority of the votes, where a vote against has the weight
    ``against`` and a vote for 1.5. Labellers that look for different faults agree
    in no fault, so for those a vote against has to weigh more at the start:
    expectation-maximisation finds the nearest of several solutions; and
    ``false_alarm`` bounds how often any of them votes against a positive. Estimates are smoothed by one row for
    each vote, so an empty table gives even odds.
    """
    total = sum(n for _, n in counts)
    post = {v: 1 / (1 + math.exp(-1.5 * v.count(1) + against * v.count(-1))) for v, _ in counts}
    share, table = prior, []
    for _ in range(rounds):
        table = []
        for j in range(len(counts[0][0]) if counts else 0):
            t = {(c, x): 1.0 for c in (0, 1) for x in VALUES}
            for v, n in counts:
                if v[j]:
                    t[1, v[j]] += n * post[v]
                    t[0, v[j]] += n * (1 - post[v])
            for c in (0, 1):
                s = sum(t[c, x] for x in VALUES)
                t |= {(c, x): t[c, x] / s for x in VALUES}
            t[1, -1] = min(t[1, -1], false_alarm)
            t[1, 1] = 1 - t[1, -1]
            table.append(t)
        share = (1 + sum(n * post[v] for v, n in counts)) / (2 + total)
        new = {}
        for v, _ in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(t[1, x] / t[0, x]) for t, x in zip(table, v) if x)
            new[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        done = max((abs(new[v] - post[v]) for v in new), default=0) < 1e-6
        post = new
        if done:
            break
    return share, table, post


def fault_classes(counts: list[tuple[tuple[int, ...], float]], alarm: float = 0.0005, worth: float = 0.01, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, ...], float]]:
    """(shares of the classes, P(vote | class) as classes x labellers x (-1, 0, 1), P(sound | pattern)) of labellers that look for different faults.

    Class 0 is sound, class j + 1 what labeller j looks for; given the class the
    labellers vote, or don't, independently. Starts from sound for patterns without
    a vote against, and for the others from equal shares of sound and the classes
    of those who vote against. Nothing is held fixed: how often each labeller votes
    against what is sound has the prior ``alarm``, which weighs as much as the
    share ``worth`` of the rows, so that a labeller who rarely votes against, and
    then alone, is taken to err, and one who often does to have found a fault. A
    class in which its labeller does not vote against more often than not is no
    fault and counts as sound. Counts that may be zero get a millionth of the rows.
    All of it is in proportion to the rows, so a table a hundred times as long
    gives the same. An empty table gives no posteriors.
    """
    if not counts:
        return np.array([1.0]), np.zeros((1, 0, 3)), {}
    votes = np.array([v for v, _ in counts])
    weight = np.array([n for _, n in counts], float)
    total, labellers = weight.sum(), votes.shape[1]
    cast = np.stack([votes == x for x in (-1, 0, 1)], 2).astype(float)
    against = cast[:, :, 0]
    post = np.concatenate([np.ones((len(votes), 1)), against], 1)
    post /= post.sum(1, keepdims=True)
    for _ in range(rounds):
        rows = weight[:, None] * post
        shares = (rows.sum(0) + 1e-6 * total) / (1 + 1e-6 * (labellers + 1)) / total
        table = np.einsum("pc,pjx->cjx", rows, cast) + 1e-6 * total
        table /= table.sum(2, keepdims=True)
        bad = (weight * post[:, 0] @ against + alarm * worth * total) / (rows[:, 0].sum() + worth * total)
        table[0] *= ((1 - bad) / table[0, :, 1:].sum(1))[:, None]
        table[0, :, 0] = bad
        odds = np.log(shares) + np.einsum("pjx,cjx->pc", cast, np.log(table))
        new = np.exp(odds - odds.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    fault = np.r_[False, table[np.arange(1, labellers + 1), np.arange(labellers), 0] > 0.5]
    return shares, table, {v: float(p) for (v, _), p in zip(counts, post[:, ~fault].sum(1))}
