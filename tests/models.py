"""Sequential models of the stateful operators, for comparison on small inputs."""

from collections import Counter


def rate_verdicts(events, limit, ttl):
    """events: (ip, arrival, seq) in any order; returns {seq: passed}."""
    state, verdicts = {}, {}
    for ip, arrival, seq in sorted(events, key=lambda e: (e[1], e[2])):
        if ip == "":
            verdicts[seq] = True
            continue
        anchor, n = state.get(ip, (None, 0))
        if anchor is None or arrival - anchor > ttl:
            anchor, n = arrival, 0
        state[ip] = (anchor, n + 1)
        verdicts[seq] = n + 1 <= limit
    return verdicts


def ring_counts(events, as_of, window, bucket):
    """events: (query, timestamp) in arrival order; returns {query: count} of the ring at `as_of`."""
    slots = window // bucket
    start, held = [0] * slots, [Counter() for _ in range(slots)]
    for query, timestamp in events:
        number = timestamp // bucket
        at = number % slots
        if number * bucket > start[at]:
            start[at], held[at] = number * bucket, Counter()
        held[at][query] += 1
    total = Counter()
    for at in range(slots):
        if start[at] >= as_of - window:
            total += held[at]
    return dict(total)
