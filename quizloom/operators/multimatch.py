"""Many patterns on one text: only those are tried whose literals the text holds.

Most patterns of a rule table cannot match without some literal word. The literals of a chapter's rules form one
trie with failure links, so a single pass over a text finds all of them, however many rules there are; the
regular expressions of these rules alone are then tried, in the rules' order. A pattern for which no literal can
be named is always tried.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule table up to this size is sent to the tasks.
SENT_RULE_BYTES = 8 * 2**20

#: Letters that match an ASCII letter when case is ignored.
_FOLD = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "K": "k"})


def folded(text: str) -> str:
    return text.translate(_FOLD).lower()


def _closing(pattern: str, at: int) -> int:
    """Place of the parenthesis that closes the one at ``at``."""
    depth, i = 0, at
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = _class_end(pattern, i)
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i
        i += 1
    raise ValueError(pattern)


def _class_end(pattern: str, at: int) -> int:
    i = at + (2 if pattern[at + 1 : at + 2] == "^" else 1)
    i += pattern[i : i + 1] == "]"
    while pattern[i] != "]":
        if pattern[i] == "[":  # a class inside a class is left to the caller
            raise ValueError(pattern)
        i += 2 if pattern[i] == "\\" else 1
    return i


def _branches(pattern: str) -> list[str]:
    out, start, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = _class_end(pattern, i)
        elif c == "(":
            i = _closing(pattern, i)
        elif c == "|":
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def _runs(branch: str) -> list[str]:
    """Literals that every match of the branch holds: plain characters in a row."""
    out, run, i = [], "", 0

    def close() -> None:
        nonlocal run
        if run:
            out.append(run)
        run = ""

    while i < len(branch):
        c = branch[i]
        if c in "?*{":
            run = run[:-1]  # the character before may be missing
            close()
            i = branch.index("}", i) if c == "{" else i
        elif c == "\\":
            i += 1
            if branch[i].isalnum():
                if branch[i] not in "bBdDwWsSAzZ":
                    raise ValueError(branch)
                close()
            else:
                run += branch[i]
        elif c == "[":
            close()
            i = _class_end(branch, i)
        elif c == "(":
            close()
            end = _closing(branch, i)
            inner = branch[i + 1 : end]
            if inner.startswith("?") and not inner.startswith("?:"):
                raise ValueError(branch)
            if branch[end + 1 : end + 2] not in ("?", "*", "{"):
                within = _runs(inner.removeprefix("?:")) if len(_branches(inner)) == 1 else []
                out += within
            i = end
        elif c in ".^$+":
            close()
        elif ord(c) < 128:
            run += c
        else:
            close()
        i += 1
    close()
    return out


def needed_literals(pattern: str) -> list[str] | None:
    """Folded literals of which every text that matches (case ignored) holds one; None: none can be named."""
    try:
        out = [max(map(folded, _runs(b)), key=len, default="") for b in _branches(pattern)]
    except (ValueError, IndexError):
        return None
    return sorted(set(out)) if all(len(s) > 1 for s in out) else None


class RuleMatcher:
    """Rules (tuples that begin with ordinal and pattern) of one chapter, in order."""

    def __init__(self, rules: list[tuple]):
        import ahocorasick

        self.rules = rules
        self.always: list[int] = []
        wanted: dict[str, list[int]] = defaultdict(list)
        for n, rule in enumerate(rules):
            literals = needed_literals(rule[1])
            if literals is None:
                self.always.append(n)
            for s in literals or []:
                wanted[s].append(n)
        self.trie = ahocorasick.Automaton()
        for s, numbers in wanted.items():
            self.trie.add_word(s, numbers)
        self.trie.make_automaton()

    def candidates(self, text: str | None) -> list[tuple]:
        if text is None:
            return []
        found = set(self.always)
        if len(self.trie):
            for _, numbers in self.trie.iter(folded(text)):
                found.update(numbers)
        return [self.rules[n] for n in sorted(found)]


def sendable(rules: DataFrame) -> bool:
    """Whether the table is small enough to be sent to the tasks."""
    size = rules.agg(F.sum(F.octet_length(F.to_json(F.struct(*rules.columns)))).alias("n")).first().n or 0
    return size <= SENT_RULE_BYTES


def candidate_rules(rules: DataFrame, group: str, columns: list[str]):
    """Function of two columns, the rules' group and a text: the rules worth trying, in order, as structs of
    ``columns`` (the first two are the order and the pattern). ``rules`` must be ``sendable``."""
    kept = rules.where(F.col(columns[1]).isNotNull()).select(group, F.struct(*columns).alias("r"))
    lists = kept.groupBy(group).agg(F.sort_array(F.collect_list("r")).alias("r")).collect()
    sent = rules.sparkSession.sparkContext.broadcast({g: [tuple(x) for x in r] for g, r in lists})
    made: dict[str, RuleMatcher] = {}

    @F.pandas_udf(f"array<{rules.select(F.struct(*columns).alias('r')).schema['r'].dataType.simpleString()}>")
    def candidates(groups: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for g, text in zip(groups, texts):
            if g not in made:
                made[g] = RuleMatcher(sent.value.get(g, []))
            out.append([dict(zip(columns, r)) for r in made[g].candidates(text)])
        return pd.Series(out)

    return candidates


def first_match(found: Column, text: Column, pattern: str = "pattern") -> Column:
    """First of the candidate structs whose pattern occurs in the text, case ignored."""
    return F.get(F.filter(found, lambda r: F.rlike(text, F.concat(F.lit("(?iU)"), r[pattern]))), F.lit(0))
