"""Task archetype of a description by votes, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.columns import any_of, trimmed

# Leading verbs, keywords that give one vote and keywords that give two.
LEADING = {
    "debug_fix": ["fix", "debug", "resolve", "diagnose", "investigate"],
    "build_new": ["build", "create", "scaffold", "implement", "write", "design"],
    "single_file_edit": ["add", "update", "edit", "change", "modify", "tweak"],
    "multi_file_refactor": ["refactor", "restructure", "reorganize", "reorganise", "migrate", "rename", "clean"],
    "research_summarize": ["summarize", "summarise", "research", "analyze", "analyse", "review", "read", "compare"],
    "qa_short": ["explain", "what", "how", "why", "is", "can"],
    "ops_repo": ["commit", "deploy", "push", "release", "publish"],
}
KEYWORDS = {
    "debug_fix": ["bug", "error", "crash", "fail", "broken", "traceback", "exception", "doesn't work", "not working"],
    "build_new": ["build", "scaffold", "from scratch", "new app", "new project", "prototype", "generate"],
    "single_file_edit": ["this file", "the file", "one file", "single file", "add a function", "add a button"],
    "multi_file_refactor": ["refactor", "across the codebase", "restructure", "reorganize", "reorganise", "rename across", "clean up", "migrate"],
    "research_summarize": ["summarize", "summarise", "research", "analy", "report", "investigate", "compare"],
    "ops_repo": ["git ", "commit", "deploy", "release", "pipeline", " ci ", "publish", "push to"],
}
STRONG = {
    "eval_pipeline_agent": ["checker / optimizer", "checker/optimizer", "skillopt", "two-agent loop", "roll out -> reflect", "bounded edit", "validation gate"],
    "exam_solver": ["cold solver", "hpat", "practice exam", "answer key", "blind sample", "question-generation"],
    "hackathon_build": ["built with claude", "hackathon", "builder track", "cerebral valley"],
}
QUESTION_WORDS = ["what", "how", "why", "is", "can", "does"]
SCAN = 1500
FILE_NAME = r"\b[\w\-/\\]+\.\w{1,5}\b"


def archetype(description: Column) -> Column:
    """The archetype with most votes; `misc` without votes or on a tie."""
    text = F.substring(F.lower(trimmed(description)), 1, SCAN)
    verb = F.regexp_extract(text, r"[a-z']+", 0)
    files = F.size(F.array_distinct(F.transform(F.regexp_extract_all(F.substring(description, 1, SCAN), F.lit(FILE_NAME), 0), lambda f: F.lower(f))))
    question = trimmed(text).endswith("?") | verb.isin(QUESTION_WORDS)
    extra = {
        "qa_short": ((F.length(text) < 120) & question & (files == 0)).cast("int"),
        "multi_file_refactor": (files >= 3).cast("int"),
        "single_file_edit": ((files == 1) & (F.length(text) < 400)).cast("int"),
    }
    labels = list(dict.fromkeys([*LEADING, *KEYWORDS, *STRONG]))
    votes = []
    for label in labels:
        n = F.lit(0)
        if label in LEADING:
            n = n + 2 * verb.isin(LEADING[label]).cast("int")
        if label in KEYWORDS:
            n = n + any_of([text.contains(k) for k in KEYWORDS[label]]).cast("int")
        if label in STRONG:
            n = n + 2 * any_of([text.contains(k) for k in STRONG[label]]).cast("int")
        votes.append(F.struct((n + extra.get(label, F.lit(0))).alias("n"), F.lit(label).alias("label")))
    ranked = F.reverse(F.array_sort(F.array(*votes)))
    first, second = F.get(ranked, 0), F.get(ranked, 1)
    return F.when(first["n"] > F.greatest(second["n"], F.lit(0)), first["label"]).otherwise(F.lit("misc"))
