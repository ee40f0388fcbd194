"""What a path says about a file: language, category, whether to skip it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by suffix.
LANGUAGES = {"java": (".java",), "markdown": (".md",), "kotlin": (".kt", ".kts"), "typescript": (".ts", ".tsx"), "javascript": (".js", ".jsx", ".mjs", ".cjs"), "python": (".py",), "sql": (".sql",)}
# Folders and files that are never indexed.
SKIPPED_FOLDERS = (".git", ".idea", ".gradle", "target", "build", "out", "node_modules", "dist", "coverage")
#: The folder in which this engine keeps its own indexes, likewise.
OWN_FOLDER = ".seekframe"
SECRET_FILES = (".env", "id_rsa", "id_ed25519", "credentials.json", "secrets.json")
SECRET_SUFFIXES = (".pem", ".key", ".p12", ".pfx")

# Where skills, agent profiles, instructions and tests are.
SKILL_ROOTS = r"^\.(github|claude|agents)/skills/"
AGENT_ROOTS = r"^\.(github|claude)/agents/.*\.md$"
INSTRUCTION = r"(^|/)(agents?|claude|gemini)\.md$|^\.github/copilot-instructions\.md$|^\.github/instructions/(.*/)?[^/]*\.instructions\.md$"
TEST_FOLDER = r"(^|/)(tests?|__tests__|src/it)/"
TEST_NAME = r"(Tests?|IT)\.java$|Tests?\.kt$"
TEST_NAME_ANY_CASE = r"(^|/)test_[^/]*\.py$|_test\.py$|\.(test|spec)\.[tj]sx?$"


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    """The language of a known suffix, else null."""
    low = F.lower(name_of(path))
    out = F.lit(None).cast("string")
    for name, suffixes in reversed(LANGUAGES.items()):
        out = F.when(low.rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"), name).otherwise(out)
    return out


def category(path: Column) -> Column:
    """The first that fits: agent profile, skill, instruction, documentation, test, source."""
    low = F.lower(path)
    test = low.rlike(TEST_FOLDER) | path.rlike(TEST_NAME) | low.rlike(TEST_NAME_ANY_CASE)
    return (
        F.when(low.rlike(AGENT_ROOTS), "AGENT_PROFILE")
        .when(low.rlike(SKILL_ROOTS), "SKILL")
        .when(low.rlike(INSTRUCTION), "INSTRUCTION")
        .when(low.endswith(".md"), "DOCUMENTATION")
        .when(test, "TEST")
        .otherwise("SOURCE")
    )


def skipped(path: Column, own: str = OWN_FOLDER) -> Column:
    """Whether a path lies in a folder that's never indexed, ``own`` among them, or is a secret file."""
    low = F.lower(path)
    parts, name = F.split(low, "/"), name_of(low)
    secret = name.isin(*SECRET_FILES) | name.startswith(".env.")
    for suffix in SECRET_SUFFIXES:
        secret = secret | name.endswith(suffix)
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in (*SKIPPED_FOLDERS, own.lower())])) | secret


def generic(kind: Column) -> Column:
    """Whether a category takes part in general search."""
    return ~kind.isin("INSTRUCTION", "AGENT_PROFILE", "SKILL")


def candidate_type(kind: Column) -> Column:
    return F.when(kind == "TEST", "TEST").when(kind == "DOCUMENTATION", "DOCUMENTATION").otherwise("FILE")


def glob_regex(glob: str) -> str:
    """A repository glob as an anchored regular expression.

    ``**/`` is any folders or none, ``**`` anything, ``*`` anything but a slash, ``?`` one such character.
    """
    out = []
    for token in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token).replace("\\ ", " "))
    return "^" + "".join(out) + "$"


#: Character classes by name, as an ignore pattern may hold them.
CLASSES = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "xdigit": r"\p{XDigit}"}
_NAMED = "|".join(CLASSES)
_TOKENS = re.compile(
    r"(?P<escape>\\(?P<plain>.))|(?P<set>\[(?P<not>[!^]?)(?P<members>\]?(?:\[:(?:" + _NAMED + r"):\]|\\.|[^\]\\])*)\])"
    r"|(?P<folders>(?:(?<=/)|^)\*\*/)|(?P<inside>(?<=/)\*\*$)|(?P<run>\*+)|(?P<one>\?)|(?P<text>[^\\\[*?])|(?P<wrong>.)",
    re.S,
)


def _members(body: str) -> str:
    """The members of a set of characters, for a regular expression."""
    out = []
    for token in re.finditer(r"\[:(\w+):\]|\\(.)|(.)", body, re.S):
        name, escaped, plain = token.groups()
        if name:
            out.append(CLASSES[name])
        else:
            out.append("-" if plain == "-" and 0 < token.start() < len(body) - 1 else re.sub(r"[\W_]", r"\\\g<0>", escaped or plain))
    return "".join(out)


def ignore_regex(body: str) -> str | None:
    """An ignore pattern, without signs and slashes around it, as an anchored regular expression; None if it's malformed."""
    out = []
    for token in _TOKENS.finditer(body):
        kind, text = token.lastgroup if token.lastgroup not in ("plain", "not", "members") else None, token.group()
        if token.group("escape"):
            out.append(re.sub(r"\W", r"\\\g<0>", token.group("plain")))
        elif token.group("set"):
            out.append(f"(?!/)[{'^' if token.group('not') else ''}{_members(token.group('members'))}]")
        elif token.group("wrong"):
            return None
        else:
            out.append({"folders": "(?:.*/)?", "inside": ".+", "run": "[^/]*", "one": "[^/]"}.get(kind) or re.sub(r"[^\w/ ]", r"\\\g<0>", text))
    return "".join(out)


Rule = tuple[str, bool, bool]


def ignore_rules(text: str) -> list[Rule]:
    """(regular expression, whether it ignores, whether it's for folders only) of an ignore file's lines, in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        ignore = not line.startswith("!")
        body = line if ignore else line[1:]
        if not body.strip("/") or line.startswith("#"):
            continue
        folders = body.endswith("/")
        body = body.rstrip("/")
        pattern = ignore_regex(body.removeprefix("/"))
        if pattern is not None:
            out.append((("" if "/" in body else "(?:.*/)?") + pattern, ignore, folders))
    return out


def _verdict(path: Column, rules: list[Rule], folder: bool) -> Column:
    """What the last rule that fits says of a path, null where none does; neighbours that say the same are one expression."""
    runs: list[tuple[bool, list[str]]] = []
    for pattern, ignore, folders in rules:
        if folder or not folders:
            if not runs or runs[-1][0] != ignore:
                runs.append((ignore, []))
            runs[-1][1].append(pattern)
    out = F.lit(None).cast("boolean")
    for ignore, patterns in runs:
        out = F.when(path.rlike(r"(?s)\A(?:" + "|".join(patterns) + r")\z"), F.lit(ignore)).otherwise(out)
    return out


def ignored(path: Column, families: list[list[tuple[str, list[Rule]]]]) -> Column:
    """Whether any family of ignore files ignores a file; of a family's (folder, rules) the last with a verdict decides.

    A folder that is ignored takes along what's in it. All in built-in functions: a path is split into the folders above it,
    and each is compared with a scope's rules.
    """
    out = F.lit(False)
    for family in families:
        decided = F.lit(None).cast("boolean")
        for scope, rules in family:
            scope = scope.strip("/")
            own = F.substring(path, len(scope) + 2, 1 << 30) if scope else path
            parts = F.split(own, "/")
            above = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, n: F.array_join(F.slice(parts, F.lit(1), n + 1), "/"))
            told = F.transform(above, lambda x: _verdict(x, rules, True))
            last = F.coalesce(_verdict(own, rules, False), F.when(F.exists(told, lambda x: ~x), F.lit(False)))
            said = F.when(F.exists(told, lambda x: x), F.lit(True)).otherwise(last)
            decided = F.coalesce(F.when(path.startswith(scope + "/"), said) if scope else said, decided)
        out = out | F.coalesce(decided, F.lit(False))
    return out
