"""Paths to languages, file classes and boosts; column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import any_of, is_test_query


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of a file name that has more before it, or ''."""
    return F.regexp_extract(filename(path), r"^.+\.([^.]*)$", 1)


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def language(path: Column) -> Column:
    by_name = {n: k for k, (_, names) in reversed(V.LANGUAGES.items()) for n in names}
    by_ext = {e: k for k, (exts, _) in reversed(V.LANGUAGES.items()) for e in exts}
    return F.coalesce(_map(by_name)[filename(path)], _map(by_ext)[extension(path)])


def file_class(path: Column) -> Column:
    """The first rule that holds: binary extension, dot file, the first telling directory, extension, source."""
    dirs = {**dict.fromkeys(V.TEST_DIRS, "Test"), **dict.fromkeys(V.DEPENDENCY_DIRS, "Dependency"), **dict.fromkeys(V.GENERATED_DIRS, "Generated"), **dict.fromkeys(V.VENDOR_DIRS, "Vendor")}
    first = F.get(F.filter(F.transform(F.split(F.lower(path), "/"), lambda c: _map(dirs)[c]), lambda x: x.isNotNull()), 0)
    ext = extension(path)
    return F.when(ext.isin(V.BINARY_EXTENSIONS), "Binary").when(filename(path).rlike(r"^\.."), "Config").when(first.isNotNull(), first).when(ext.isin(V.DOC_EXTENSIONS), "Documentation").when(ext.isin(V.CONFIG_EXTENSIONS), "Config").otherwise("Source")


def class_boost(cls: Column) -> Column:
    return F.coalesce(_map(V.FILE_CLASS_BOOST)[cls], F.lit(1.0))


def directory_boost(path: Column) -> Column:
    p = F.lower(path)
    ends = F.lit(False)
    for e in V.README_ENDINGS:
        ends = ends | p.endswith(e)
    b = V.DIRECTORY_BOOST
    return F.when(ends, b["ending"]).when(any_of(p, "/docs/", "/.github/"), b["docs"]).when(p.startswith("types/") | any_of(p, "/types/"), b["types"]).when(any_of(p, "pnpm-workspace.yaml", "lerna.json", "nx.json"), b["workspace"]).otherwise(1.0)


def authority_boost(path: Column) -> Column:
    p, name = F.lower(path), F.lower(filename(path))
    md, b = p.endswith(".md"), V.AUTHORITY_BOOST
    return (
        F.when(name == "readme.md", b["readme"])
        .when(name.startswith("readme.") & name.endswith(".md"), b["readme.x"])
        .when(p.endswith("docs/index.md"), b["index"])
        .when((any_of(p, "/docs/") | p.startswith("docs/")) & md, b["docs"])
        .when((any_of(p, "/.github/") | p.startswith(".github/")) & md, b["github"])
        .when(~any_of(p, "/") & md, b["root"])
        .otherwise(1.0)
    )


def intent_weight(intent: Column, cls: Column) -> Column:
    table = {f"{i}|{c}": w for i, ws in V.INTENT_WEIGHTS.items() for c, w in zip(("Documentation", "Config", "Source", "Test"), ws)}
    return F.coalesce(_map(table)[F.concat_ws("|", intent, cls)], F.when(cls == "Generated", 0.5).otherwise(0.0))


def test_multiplier(query: Column, cls: Column) -> Column:
    return F.when(cls != "Test", 1.0).when(is_test_query(query), V.TEST_BOOST).otherwise(V.TEST_PENALTY)


def segment_matches(tokens: Column, path: Column) -> Column:
    """How many tokens lie within one run of letters and digits of the path."""
    segments = F.split(F.lower(path), "[^a-z0-9]+")
    return F.size(F.filter(tokens, lambda t: F.exists(segments, lambda s: F.contains(s, t))))


def segment_holds(path: Column, token: Column) -> Column:
    """Whether a token lies within one run of letters and digits of the path."""
    return F.exists(F.split(F.lower(path), "[^a-z0-9]+"), lambda s: F.contains(s, token))


def symbol_boost(tokens: Column, path: Column, content: Column) -> Column:
    """1 and more by the share of tokens that the path or the content holds."""
    low = F.lower(content)
    matched = F.size(F.filter(tokens, lambda t: segment_holds(path, t) | F.contains(low, t)))
    return 1 + F.when(F.size(tokens) > 0, matched / F.greatest(F.size(tokens), F.lit(1))).otherwise(0.0) * V.SYMBOL_WEIGHT


def combined_boost(intent: Column, query: Column, path: Column, cls: Column) -> Column:
    """Intent weight, test multiplier, directory and authority in one factor."""
    return intent_weight(intent, cls) * test_multiplier(query, cls) * directory_boost(path) * authority_boost(path)


def language_of(name: Column) -> Column:
    """The language that a name or an alias of it stands for, in any case; null if there is none."""
    names = {**V.LANGUAGE_ALIASES, **{k: k for k in V.LANGUAGES}}
    return _map(names)[F.lower(name)]


def class_of_language(language_: Column) -> Column:
    return F.when(language_.isin("markdown", "text"), "Documentation").when(language_.isin("yaml", "toml", "json", "xml"), "Config").otherwise("Source")


def indexable(path: Column) -> Column:
    """Whether a file is indexed: its language is known, or its ending or name stands for text."""
    last = F.substring_index(path, ".", -1)
    return language(path).isNotNull() | last.isin(V.TEXT_EXTENSIONS) | F.lower(filename(path)).isin(V.TEXT_NAMES)


def binary_by_name(path: Column) -> Column:
    return F.lower(extension(path)).isin(V.BINARY_EXTENSIONS)


def valid_path(path: Column) -> Column:
    """Whether a text may be a path: five bytes or more, none of some words, with a separator or a dot."""
    return (F.octet_length(path) >= 5) & ~F.lower(path).isin(V.NO_PATHS) & any_of(path, "/", "\\", ".")


def unsafe_root(path: Column) -> Column:
    """Whether a text is no folder to index: a root, a bare drive, the root of a share."""
    bare = F.regexp_replace(path, r"[/\\]+$", "")
    share = path.startswith("\\\\") & (F.size(F.filter(F.split(path, r"[/\\]+"), lambda x: ~x.isin("", "?"))) <= 2)
    return (bare == "") | bare.rlike("^[A-Za-z]:$") | share


def repository_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 12)


def task_hash(message: Column, max_tokens: Column | int, order: list[str], state: Column) -> Column:
    """16 digits that name a request under its limits: of the message, the limit as eight bytes, the order of parts and the repository's state."""
    limit = max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)
    bytes_ = F.unhex(F.lpad(F.hex(limit.cast("long")), 16, "0"))
    return F.substring(F.sha2(F.concat(F.encode(message, "UTF-8"), bytes_, F.encode(F.lit(",".join(order)), "UTF-8"), F.encode(state, "UTF-8")), 256), 1, 16)


# --- the same in SQL, for oracles ---------------------------------------------------------------

EXT_SQL = r"regexp_extract(regexp_extract({p}, '([^/]*)$', 1), '^.+\.([^.]*)$', 1)"


def file_class_sql(p: str) -> str:
    ext = EXT_SQL.format(p=p)
    groups = (("Vendor", V.VENDOR_DIRS), ("Generated", V.GENERATED_DIRS), ("Dependency", V.DEPENDENCY_DIRS), ("Test", V.TEST_DIRS))
    each = "CASE " + " ".join(f"WHEN x IN {V.sql_list(d)} THEN '{c}'" for c, d in groups) + " END"
    first = f"list_filter(list_transform(string_split(lower({p}), '/'), lambda x: {each}), lambda y: y IS NOT NULL)[1]"
    return f"CASE WHEN {ext} IN {V.sql_list(V.BINARY_EXTENSIONS)} THEN 'Binary' WHEN regexp_matches(regexp_extract({p}, '([^/]*)$', 1), '^\\..') THEN 'Config' WHEN {first} IS NOT NULL THEN {first} WHEN {ext} IN {V.sql_list(V.DOC_EXTENSIONS)} THEN 'Documentation' WHEN {ext} IN {V.sql_list(V.CONFIG_EXTENSIONS)} THEN 'Config' ELSE 'Source' END"


def class_boost_sql(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.FILE_CLASS_BOOST.items()) + " ELSE 1.0 END"
