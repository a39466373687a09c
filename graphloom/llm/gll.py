"""A small generalised LL recogniser on a graph-structured stack.

A grammar maps each nonterminal to its alternatives; an alternative is a
tuple of symbols, and a symbol that is no nonterminal is a terminal.  The
recogniser follows all alternatives at once.  Calls of one nonterminal at one
place share a node of the stack, so ambiguous and recursive grammars take
polynomial time and no recursion.  A pair of brackets with all that is between
may be one symbol, so a text costs what it has outside of brackets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

Grammar = dict[str, tuple[tuple[str, ...], ...]]

#: Symbols that stand for a bracket, the one that closes it and all between.
ISLANDS = {"()": "(", "[]": "[", "{}": "{", "<>": "<"}


def islands(tokens: Sequence[str]) -> dict[int, int]:
    """Where each bracket closes that has nothing but whole brackets within.

    Signs `<` and `>` are a pair only directly within the same bracket; else
    they are comparisons, which break no bracket around them.
    """
    closing = {")": "(", "]": "[", "}": "{"}
    out: dict[int, int] = {}
    opened: list[int] = []
    for i in [i for i, token in enumerate(tokens) if token in "()[]{}<>"]:
        token = tokens[i]
        if token in ("(", "[", "{", "<"):
            opened.append(i)
        elif token == ">":
            if opened and tokens[opened[-1]] == "<":
                out[opened.pop()] = i
        elif token in closing:
            while opened and tokens[opened[-1]] == "<":
                opened.pop()
            if opened and tokens[opened[-1]] == closing[token]:
                out[opened.pop()] = i
            else:
                opened.clear()  # all that is open here holds a bracket that fits nothing
    return out


def grammar(rules: str) -> Grammar:
    """A grammar from lines `Name = a b | c`, `_` standing for nothing."""
    out = {}
    for line in filter(None, map(str.strip, rules.splitlines())):
        name, _, body = line.partition(" = ")
        out[name] = tuple(tuple(x for x in part.split() if x != "_") for part in body.split(" | "))
    return out


def ends(rules: Grammar, start: str, tokens: Sequence[str], at: int, fits: Callable[[str, str], bool], whole: Mapping[int, int] | None = None) -> set[int]:
    """The places where a text derived from `start` that begins at `at` may end; none if there is no such text.

    whole: where the brackets of the tokens close, as `islands` gives it, for
    grammars that have such symbols.
    """
    whole = whole or {}
    root = (start, at)
    callers: dict[tuple[str, int], list] = {root: []}
    popped: dict[tuple[str, int], set[int]] = {root: set()}
    todo = [(alternative, 0, root, at) for alternative in rules[start]]
    seen = set(todo)
    size = len(tokens)
    while todo:
        alternative, dot, node, place = todo.pop()
        while dot < len(alternative) and alternative[dot] not in rules:
            if place >= size:
                break
            if alternative[dot] in ISLANDS:
                if tokens[place] != ISLANDS[alternative[dot]] or place not in whole:
                    break
                place = whole[place]
            elif not fits(alternative[dot], tokens[place]):
                break
            dot, place = dot + 1, place + 1
        else:
            if dot == len(alternative):
                if place not in popped[node]:
                    popped[node].add(place)
                    for back in callers[node]:
                        step = (*back, place)
                        if step not in seen:
                            seen.add(step)
                            todo.append(step)
                continue
            called = (alternative[dot], place)
            back = (alternative, dot + 1, node)
            if called not in callers:
                callers[called], popped[called] = [back], set()
                for option in rules[called[0]]:
                    step = (option, 0, called, place)
                    if step not in seen:
                        seen.add(step)
                        todo.append(step)
            elif back not in callers[called]:
                callers[called].append(back)
                for end in list(popped[called]):
                    step = (*back, end)
                    if step not in seen:
                        seen.add(step)
                        todo.append(step)
    return popped[root]
