"""String expressions: trimming, cutting, defaults and closed lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters each trimming rule removes.
_SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
FORM_BLANKS = "\t\n\x0b\x0c\r\ufeff" + _SPACES
TEXT_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" + _SPACES

INPUT_FIELDS = ("ticket_id", "job_name", "description", "tws_log", "script_name", "command")
OPTIONAL_FIELDS = ("script_name", "command")


def strip(col: Column, blanks: str = TEXT_BLANKS) -> Column:
    return F.trim(col, F.lit(blanks))


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def non_empty(col: Column) -> Column:
    """Null for the empty string, so that ``coalesce`` can skip it."""
    return F.nullif(col, F.lit(""))


def normalise_input(inc: DataFrame) -> DataFrame:
    """Trim the six input fields; blank optional fields become null."""
    trimmed = {c: strip(F.col(c), FORM_BLANKS) for c in INPUT_FIELDS if c in inc.columns}
    for c in OPTIONAL_FIELDS:
        if c in trimmed:
            trimmed[c] = non_empty(trimmed[c])
    return inc.withColumns(trimmed)


def truncate(text: Column, n: int, mark: str = "") -> Column:
    """The first ``n`` characters; ``mark`` is added only when something was cut."""
    cut = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(cut, F.lit(mark))).otherwise(cut) if mark else cut


def coerce_enum(col: Column, allowed: Iterable[str], default: str) -> Column:
    return F.when(col.isin(*allowed), col).otherwise(F.lit(default))


def script_request(script_name: Column, job_name: Column) -> Column:
    """The script an incident asks for: its own, else one named after the job."""
    return F.coalesce(non_empty(script_name), F.concat(job_name, F.lit(".py")))


def script_target(script_name: Column, job_name: Column) -> Column:
    """The file name looked up for a request: names without a known suffix get ``.py``."""
    name = script_request(script_name, job_name)
    known = F.endswith(name, F.lit(".py")) | F.endswith(name, F.lit(".sh"))
    return F.when(known, name).otherwise(F.concat(name, F.lit(".py")))


def log_target(name: Column) -> Column:
    return F.when(F.endswith(name, F.lit(".log")), name).otherwise(F.concat(name, F.lit(".log")))


def file_label(encoded: Column) -> Column:
    """A file name as it is on disk; Spark reports paths in URL form, where a plus is a plus."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


# The environment variables a node may report.
ENV_NAMES = ("PATH", "PYTHONPATH", "JAVA_HOME", "TWS_HOME", "TWS_ENV", "LD_LIBRARY_PATH")


def env_allow_list(env: Column) -> Column:
    return F.map_filter(env, lambda name, value: name.isin(*ENV_NAMES) & (value != ""))


def document_text(summary: Column, details: Column, resolution: Column, job: Column, description: Column) -> Column:
    """The text of a past incident that is embedded and stored; a null summary gives way to the description."""
    lead = F.coalesce(summary, description, F.lit(""))
    rich = strip(F.concat_ws(" ", lead, or_empty(details), or_empty(resolution)))
    bare = F.concat(F.lit("Job: "), or_empty(job), F.lit(" Description: "), or_empty(description))
    return F.when(rich == "", bare).otherwise(rich)
