"""Condition labels, triggers, and ids in names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data sets: conditions, their names, and triggers that mark no condition.
TASKS = ("T12", "T22", "T32")
NAMES = {
    "code": {"T12": "T12", "T22": "T22", "T32": "T32"},
    "zh": {"T12": "低", "T22": "中", "T32": "高"},
    "en": {"T12": "low", "T22": "medium", "T32": "high"},
    "condition": {"T12": "low_trust", "T22": "medium_trust", "T32": "high_trust"},
}
INVALID_TRIGGERS = ("none", "no trigger", "nano", "nonenone", "base.", "hpaay", "none.", "")
MISSPELT = {"anxitey": "anxiety", "terrify": "disgust", "null": "none", "drive": "none"}
TASK_SUFFIX = r"(?i)(T(?:12|22|32))$"


def _mapped(c: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c)


def label(task: Column, mode: str = "en", otherwise: Column | None = None) -> Column:
    """The task's name in one of NAMES; null, or `otherwise`, for others."""
    if mode not in NAMES:
        raise ValueError(f"no label mode {mode!r}; there are {', '.join(NAMES)}")
    found = _mapped(task, NAMES[mode])
    return found if otherwise is None else F.coalesce(found, otherwise)


def condition(task: Column) -> Column:
    """Name of the condition; `unknown` for other tasks."""
    return label(F.upper(task), "condition", F.lit("unknown"))


def scr_condition(task: Column) -> Column:
    """As condition, but other tasks stand for themselves."""
    return label(F.upper(task), "condition", task)


def is_target(trigger: Column) -> Column:
    """Whether a trigger names a task exactly, white space around it aside."""
    return F.coalesce(F.trim(trigger).isin(*TASKS), F.lit(False))


def trigger(raw: Column) -> Column:
    """Lower case, trimmed, known misspellings mended; null becomes `none`."""
    low = F.coalesce(F.lower(F.trim(raw)), F.lit("none"))
    return F.coalesce(_mapped(low, MISSPELT), low)


def is_valid_trigger(normalised: Column) -> Column:
    return ~normalised.isin(*INVALID_TRIGGERS)


def subject_number(name: Column) -> Column:
    """T007, t7 or 7 -> 7; null for others."""
    return F.regexp_extract(name, r"^[Tt]?0*(\d+)$", 1).try_cast("int")


def subject_order(name: Column) -> Column:
    """For sorting: the number, 999 for names without one."""
    return F.coalesce(subject_number(name), F.lit(999))


def subject_id(number: Column) -> Column:
    return F.format_string("T%03d", number)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]+$", "")


def field(path: Column, index: int) -> Column:
    """The index-th part of the file's stem between underscores, null if there is none; -1 for the last."""
    parts = F.split(stem(path), "_")
    return F.try_element_at(parts, F.lit(index + 1 if index >= 0 else index))


def suffix_task(path: Column) -> Column:
    """The task that a file's stem ends with, in capitals, else UNKNOWN."""
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(stem(path), TASK_SUFFIX, 1)), F.lit("")), F.lit("UNKNOWN"))


def path_subject(path: Column) -> Column:
    """The subject's folder in a path, null without one."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)([Tt]\d+)/", 1), F.lit(""))


def plot_trigger(name: Column) -> Column:
    """The trigger in a plot's file name `<id>_<trigger>_plot.png`, lower case, null for other names."""
    return F.nullif(F.lower(F.regexp_extract(name, r"(?i)^[^_]+_(.+)_plot\.png$", 1)), F.lit(""))


def safe_name(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", ""), F.lit("")), F.lit("unknown"))


def joined(names: Column, separator: str = "|") -> Column:
    return F.array_join(names, separator)


def message(text: Column) -> Column:
    """An error message as failure tables hold it."""
    return F.substring(text, 1, 200)
