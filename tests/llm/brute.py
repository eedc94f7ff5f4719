"""Plain answers for small inputs."""

from __future__ import annotations


def components(nodes, linked):
    """The smallest node reachable from each node."""
    nodes, seen, out = sorted(nodes), set(), {}
    for start in nodes:
        if start in seen:
            continue
        todo = [start]
        seen.add(start)
        while todo:
            x = todo.pop()
            out[x] = start
            for y in nodes:
                if y not in seen and linked(x, y):
                    seen.add(y)
                    todo.append(y)
    return out


def one_edit(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
