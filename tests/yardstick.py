"""Louvain node by node over one small graph: the yardstick for the parallel one."""

from kgspark.schema import GAIN_EPSILON


def sequential_communities(ends: list[tuple[str, str, float]], max_levels: int, max_passes: int) -> dict[str, str]:
    """Louvain over one small weighted graph, node by node in the order of their names; a community is named by its first node."""
    names = sorted({n for a, b, _ in ends for n in (a, b)})
    place = {n: i for i, n in enumerate(names)}
    links: list[dict[int, float]] = [{} for _ in names]
    loops = [0.0] * len(names)
    for a, b, w in ends:
        for x, y in ((place[a], place[b]), (place[b], place[a])):
            links[x][y] = links[x].get(y, 0.0) + w
    total, at = sum(w for _, _, w in ends), list(range(len(names)))
    for _ in range(max_levels):
        degree = [2 * loops[i] + sum(links[i].values()) for i in range(len(links))]
        home, sigma, moved = list(range(len(links))), list(degree), False
        for _ in range(max_passes):
            quiet = True
            for i, own in enumerate(list(home)):
                into: dict[int, float] = {own: 0.0}
                for j, w in links[i].items():
                    into[home[j]] = into.get(home[j], 0.0) + w
                sigma[own] -= degree[i]
                gain = lambda c, i=i, into=into: into[c] / total - sigma[c] * degree[i] / (2 * total * total)
                best = max(sorted(into), key=gain)
                target = best if gain(best) > gain(own) + GAIN_EPSILON else own
                sigma[target] += degree[i]
                if target != own:
                    home[i], quiet, moved = target, False, True
            if quiet:
                break
        if not moved:
            break
        new = {c: n for n, c in enumerate(dict.fromkeys(home))}
        at = [new[home[i]] for i in at]
        up: list[dict[int, float]] = [{} for _ in new]
        inside = [0.0] * len(new)
        for i, near in enumerate(links):
            c = new[home[i]]
            inside[c] += loops[i]
            for j, w in near.items():
                d = new[home[j]]
                if c == d:
                    inside[c] += w / 2
                else:
                    up[c][d] = up[c].get(d, 0.0) + w
        links, loops = up, inside
    first: dict[int, str] = {}
    return {n: first.setdefault(at[i], n) for i, n in enumerate(names)}
