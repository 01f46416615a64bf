"""What the engine decides on the driver before it builds a plan."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Plan:
    lexical_weight: float = 1.0
    structural_weight: float = 0.0
    symbols: bool = True
    graph: bool = False


def plan(intent: str, pattern: bool = False) -> Plan:
    """Weights of the backends by intent."""
    if intent == "Structural" and pattern:
        return Plan(0.3, 1.0)
    if intent in ("Implementation", "Debugging"):
        return Plan(1.0, 0.4, graph=intent == "Debugging")
    if intent in ("Procedural", "Configuration"):
        return Plan(symbols=False)
    return Plan()


def max_files(docs: int, pinned: int | None = None) -> int:
    """Files of an answer: few for a middling repository, more for a small or large one; a pin wins."""
    return pinned if pinned is not None else 50 if docs <= 500 or docs > 5000 else 20


def candidates(docs: int, files: int, wanted: int | None = None) -> int:
    """Candidates of a search: 100, 200 beyond 5000 files, four an answer's file at least, 1000 at most."""
    return min(1000, max(wanted if wanted is not None else 200 if docs > 5000 else 100, 4 * files))


def max_evidence(files: int, both: bool) -> int:
    return files + files // 2 if both else files


#: Files of a corpus up to which edges count, for queries that have such a limit.
GRAPH_FILES = 5000


def graph_allowed(wanted: bool, hits: int, docs: int, files: int, most: int | None = GRAPH_FILES) -> bool:
    """If edges count: where they are wanted, for two hits or more, in a corpus of at most `most` files, or of any number if that is None."""
    return wanted and hits >= 2 and (most is None or docs <= most or files <= most)


#: Files and matches of an exhaustive structural request, and the words that make one.
EXHAUSTIVE = (500, 500)
EXHAUSTIVE_WORDS = ("all ", "every ", "list all", "find all", "show all")


def exhaustive(intent: str, query: str) -> tuple[int, int] | None:
    """Limits of a structural request that asks for everything, else None."""
    return EXHAUSTIVE if intent == "Structural" and any(w in query.lower() for w in EXHAUSTIVE_WORDS) else None


def structural_stop(files: int) -> int:
    """Matches after which a structural search may stop."""
    return 2 * files


def skip_tests(intent: str, query: str) -> bool:
    return intent != "Testing" and "test" not in query.lower()


def validate(settings: dict) -> list[str]:
    """What is wrong with settings: limits must be positive, weights between 0 and 10, the share of documentation between 0 and 1."""
    out = [f"{k} must be 1 or more" for k in ("max_files", "candidate_k", "max_lines", "token_budget") if k in settings and settings[k] < 1]
    out += [f"{k} must be between 0 and 10" for k in ("lexical_weight", "structural_weight") if k in settings and not 0 <= settings[k] <= 10]
    if not 0 <= settings.get("docs_share", 0.45) <= 1:
        out.append("docs_share must be between 0 and 1")
    return out


def merge_settings(*layers: dict) -> dict:
    """Layers of sections put together: a later layer's section takes the whole place of an earlier one's."""
    out: dict = {}
    for layer in layers:
        out |= layer
    return out
