"""Fixed values that must equal the producer side for equal results.

Classification rules are ordered: the first matching rule wins. The
producer's regexes use ``\\b`` with ASCII word characters; Java's ``\\b``
also treats accented letters as word characters, so every word boundary
is written as an explicit ASCII class instead. Each pattern runs unchanged
under Java regex (Spark) and RE2 (the DuckDB oracle).
"""

from __future__ import annotations

# ---- fixed values --------------------------------------------------------
# Prompt intent rules, in priority order (case-insensitive, whole words).
INTENT_RULES = [
    ("bug_fix", ["fix", "bug", "broken", "crash(ed|es|ing)?", "error", "fail(s|ed|ing)?", "regression"]),
    ("test", ["test", "tests", "testing", "spec", "coverage"]),
    ("refactor", ["refactor", "clean ?up", "simplify", "reorgani[sz]e", "restructure"]),
    ("feature", ["add", "implement", "create", "build", "support for", "new feature"]),
]
INTENT_FALLBACK = "other"
# Words that make a prompt "mention tests" (note: no "coverage").
MENTIONS_TESTS_WORDS = ["test", "tests", "testing", "spec"]

# Shell command categories, in priority order.
COMMAND_RULES = [
    ("test", ["pytest", "npm test", "npm run test", "yarn test", "go test", "jest", "mvn test",
              "cargo test", "rspec", "phpunit"]),
    ("build", ["npm run build", "yarn build", "make", "docker build", "webpack", "tsc", "cargo build",
               "mvn (package|install|compile)", "go build"]),
]
COMMAND_GIT_PATTERN = r"(?i)^\s*git\s+"
COMMAND_FALLBACK = "other"

# Test-runner detection over telemetry commands: case-insensitive, no word boundaries.
TEST_RUNNERS = ["pytest", "npm test", "npm run test", "yarn test", "go test", "jest", "mvn test", "cargo test"]
# A commit command: start of the string only.
COMMIT_PATTERN = r"(?i)^\s*git\s+commit"

# Ticket key as found in a branch name.
ISSUE_KEY_PATTERN = r"([A-Z][A-Z0-9]{1,9}-[0-9]+)"

# Commit trailers (multi-line) and diff shortstat parts.
SESSION_TRAILER_PATTERN = r"(?m)^Session-Id:\s*(\S+)"
ISSUE_TRAILER_PATTERN = r"(?m)^Jira-Issue:\s*(\S+)"
SHORTSTAT_FILES_PATTERN = r"([0-9]+) files? changed"
SHORTSTAT_INSERTIONS_PATTERN = r"([0-9]+) insertions?\(\+\)"
SHORTSTAT_DELETIONS_PATTERN = r"([0-9]+) deletions?\(-\)"

# Accepted CI statuses (after lower-casing) and the default check name.
CI_STATUSES = ["success", "failure", "error", "pending", "cancelled"]
CI_DEFAULT_CHECK = "default"

# A landed line counts as blank when it holds only whitespace (JS trim set).
BLANK_LINE_PATTERN = r"^[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]*$"

# Ticket label on the time-split panel.
LABEL_MAX = 50
LABEL_KEEP = 49
LABEL_ELLIPSIS = "…"
NO_SUMMARY = "(no summary)"
# ---- end of fixed values -------------------------------------------------

_WORD = "A-Za-z0-9_"


def whole_words(alternatives: list[str]) -> str:
    """Case-insensitive pattern matching any alternative as a whole ASCII word."""
    return f"(?i)(^|[^{_WORD}])({'|'.join(alternatives)})([^{_WORD}]|$)"


def any_of(alternatives: list[str]) -> str:
    """Case-insensitive pattern matching any alternative anywhere."""
    return f"(?i)({'|'.join(alternatives)})"


INTENT_PATTERNS = [(name, whole_words(words)) for name, words in INTENT_RULES]
MENTIONS_TESTS_PATTERN = whole_words(MENTIONS_TESTS_WORDS)
COMMAND_PATTERNS = [(name, whole_words(words)) for name, words in COMMAND_RULES] + [
    ("git", COMMAND_GIT_PATTERN)
]
TEST_RUN_PATTERN = any_of(TEST_RUNNERS)
