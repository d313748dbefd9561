"""Reading and printing of PENMAN graphs, in plain Python, for use inside Arrow functions.

A graph is (root id, nodes, edges): nodes map an id to (variable or None, concept); edges are (source, label,
target, kind) with kind ``tree`` or ``reentrant``. Ids are Gorn addresses: the root is 0, the i-th tree child of x is
x.i, and re-entrant edges take no number.
"""

from __future__ import annotations

import itertools
import re

TOKEN = re.compile(r'"[^"]+"|[()]|[^ \t\n()":]+|:[^ \t\n()":]+')


class PenmanError(ValueError):
    pass


def tokenize(text: str) -> list[str]:
    """Brackets, labels (with their colon), names and quoted strings; an unquoted name may hold inner colons only in labels."""
    found = TOKEN.findall(text)
    if "".join("".join(found).split()) != "".join(text.split()):
        raise PenmanError("text outside the grammar")
    return found


def read(text: str, gorn: bool = True):
    """The graph of a PENMAN expression. A leaf whose concept is a variable of the graph becomes a re-entrancy.

    Ids are Gorn addresses, or with ``gorn`` false the numbers of the nodes in the text's order, which are short at any
    depth. One pass over the tokens with a stack of the open brackets: depth is bounded by memory alone, and an error
    tells the character at which it is.
    """
    tokens, at = tokenize(text), 0
    if not tokens:
        raise PenmanError("empty expression")

    def wrong(what: str, k: int):
        place = next(itertools.islice(TOKEN.finditer(text), k, None), None)
        raise PenmanError(f"{what} at character {place.start() if place else len(text)}")

    def take() -> str:
        nonlocal at
        at += 1
        if at > len(tokens):
            wrong("expression ends early", at)
        return tokens[at - 1]

    # Variable, concept, parent, relation and whether it is a bare word, for each node in the order of the text.
    met: list[tuple] = []
    open_: list[int] = []
    by_var: dict[str, int] = {}
    while True:
        label = parent = None
        if open_:
            token = take()
            if token == ")":
                open_.pop()
                if open_:
                    continue
                break
            if token[0] != ":":
                wrong(f"relation expected, not {token},", at - 1)
            label, parent = token, open_[-1]
        first = take()
        if first == ")" or first[0] == ":":
            wrong(f"node expected, not {first},", at - 1)
        if first != "(":
            met.append((None, first, parent, label, True))
            if not open_:
                break
            continue
        name, var = take(), None
        if at < len(tokens) and tokens[at] == "/":
            at += 1
            var, name = name, take()
            by_var.setdefault(var, len(met))
        if name in "()":
            wrong("concept expected", at - 1)
        open_.append(len(met))
        met.append((var, name, parent, label, False))
    if at != len(tokens):
        wrong("text after the expression", at)
    ids: list[str] = []
    children = [0] * len(met)
    nodes: dict = {}
    again: list[tuple] = []
    edges: list[tuple] = []
    for k, (var, concept, parent, label, bare) in enumerate(met):
        if bare and k and concept in by_var:
            again.append((len(edges), by_var[concept]))
            ids.append("0")
            edges.append((ids[parent], label, None, "reentrant"))
            continue
        if not k:
            id = "0"
        else:
            id = f"{ids[parent]}.{children[parent]}" if gorn else str(k)
            children[parent] += 1
            edges.append((ids[parent], label, id, "tree"))
        ids.append(id)
        nodes[id] = (var, concept)
    for e, k in again:
        edges[e] = (*edges[e][:2], ids[k], "reentrant")
    return "0", nodes, edges


def is_constant(concept: str) -> bool:
    return concept[:1] in '"0123456789' and bool(concept) or concept == "-"


def show(graph, detail: int = 1, pretty: bool = False) -> str:
    """The graph as text: detail 0 without variables (children sorted by label and concept), 1 with them, 2 with ids too.

    Tree children come before re-entrant ones. A constant shows its variable only if it is the root or is referred to,
    or in detail 2. ``pretty`` starts a line for each relation, six spaces deeper than its node's. What is still to
    be written waits on a stack, so depth is bounded by memory alone.
    """
    root, nodes, edges = graph
    own: dict[str, list] = {}
    back: dict[str, list] = {}
    for source, label, target, kind in edges:
        (own if kind == "tree" else back).setdefault(source, []).append((label, target))
    referenced = {root} | {t for lists in back.values() for _, t in lists}
    refer = lambda t: nodes[t][1] if not detail else (f"[{t}] " if detail == 2 else "") + (nodes[t][0] or nodes[t][1])
    out: list[str] = []
    waiting: list = [(root, 0)]
    while waiting:
        item = waiting.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        at, depth = item
        var, concept = nodes[at]
        down, again = own.get(at, []), back.get(at, [])
        if detail == 0:
            down, again = (sorted(x, key=lambda e: e[0] + " " + nodes[e[1]][1]) for x in (down, again))
        named = var is not None and (not is_constant(concept) or at in referenced or detail == 2 or bool(down or again))
        head = (f"[{at}] " if detail == 2 else "") + (f"{var} / {concept}" if detail and named else concept)
        if not down and not again:
            out.append(f"({head})" if detail and named else head)
            continue
        glue = " \n" + "      " * (depth + 1) if pretty else " "
        out.append("(" + head)
        waiting.append(")")
        waiting += [f"{glue}{label} {refer(target)}" for label, target in reversed(again)]
        for label, target in reversed(down):
            waiting += [(target, depth + 1), f"{glue}{label} "]
    return "".join(out)


def parents(graph) -> dict[str, tuple[str, str]]:
    """The node above each node of the tree and the label between them."""
    return {target: (source, label) for source, label, target, kind in graph[2] if kind == "tree"}


def cut_out(graph, ids: list[str], above=None):
    """The fragment of the tree that the ids name: its first is the head, each further one a tree child of one before it.

    Ids come in the order of a walk; what they name must hang together. Children are numbered anew from 0 and
    re-entrant edges are left behind. ``above`` is what ``parents`` gives, for many fragments of one graph.
    """
    if not ids:
        raise PenmanError("a fragment without nodes")
    nodes = graph[1]
    above = parents(graph) if above is None else above
    for at in ids:
        if at not in nodes:
            raise PenmanError(f"no node {at}")
    new, children, kept, way = {ids[0]: "0"}, {ids[0]: 0}, [], [ids[0]]
    for at in ids[1:]:
        parent, label = above.get(at, (None, None))
        while way and way[-1] != parent:
            way.pop()
        if not way or at in new:
            raise PenmanError(f"fragment falls apart at {at}")
        new[at], children[at] = f"{new[parent]}.{children[parent]}", 0
        children[parent] += 1
        kept.append((new[parent], label, new[at], "tree"))
        way.append(at)
    return "0", {new[at]: nodes[at] for at in ids}, kept


def spanning_tree(root: str, edges: list[tuple[str, str, str]]):
    """(tree edges, re-entrant edges) by a walk from the root, nearest first.

    A relation costs its source's depth, followed backwards (as ``-of``) 1000 more, for that edge alone; equal costs go
    by when they were met, and a node's relations are met by label, forward ones first. A forward relation that leads
    to a node already reached is re-entrant; a backward one to such a node is the other side of an edge and is left out.
    """
    import heapq

    forward: dict[str, list] = {}
    backward: dict[str, list] = {}
    for source, label, target in edges:
        if label.endswith("-of") and label != "-of":
            source, label, target = target, label[:-3], source
        forward.setdefault(source, []).append((label, target))
        backward.setdefault(target, []).append((label + "-of", source))
    reached, tree, again, queue, met = set(), [], [], [(0, 0, 0, "", "", root)], 0
    while queue:
        _, _, depth, parent, label, here = heapq.heappop(queue)
        if here in reached:
            if not label.endswith("-of"):
                again.append((parent, label, here))
            continue
        reached.add(here)
        if depth:
            tree.append((parent, label, here))
        for extra, found in ((0, [e for e in forward.get(here, []) if e[1] != parent]), (1000, backward.get(here, []))):
            for label, other in sorted(found, key=lambda e: e[0]):
                met += 1
                heapq.heappush(queue, (depth + extra, met, depth + 1, here, label, other))
    return tree, again


def free_name(initial: str, taken) -> str:
    """The initial, or the initial with the least number from 2 on that is free."""
    if initial not in taken:
        return initial
    return next(f"{initial}{k}" for k in itertools.count(2) if f"{initial}{k}" not in taken)


def name_apart(names: list[str | None]) -> list[str | None]:
    """Variables in the order of a walk; one that was there before is given the next free name of its initial."""
    taken: set[str] = set()
    out: list[str | None] = []
    for name in names:
        if name is not None:
            name = free_name(name[0], taken) if name in taken else name
            taken.add(name)
        out.append(name)
    return out


def numbered_ops(children: list[tuple[str, str]], starts: dict[str, int]) -> list[tuple[str, str]]:
    """``:op`` children first, numbered by where their spans start; those without a start after the others."""
    ops = sorted((c for c in children if c[0] == ":op"), key=lambda c: (starts.get(c[1], 1 << 30), c[1]))
    return [(f":op{k}", c) for k, (_, c) in enumerate(ops, 1)] + [c for c in children if c[0] != ":op"]
