"""Permission rules for tool calls: the last rule that matches decides, the strictest part wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import text as tx

STRICTNESS = ("allow", "ask", "deny")
SHELL_PARTS = r"&&|\|\||\$\(|[;|&\n()`]"


@dataclass(frozen=True)
class Rule:
    """Shell patterns for the tool and for its main argument, and what follows."""

    tool: str
    pattern: str
    action: str

    def __post_init__(self) -> None:
        if self.action not in STRICTNESS:
            raise ValueError(f"invalid action {self.action!r} for tool {self.tool!r}")


def with_defaults(defaults: dict[str, str], overrides: list[Rule]) -> list[Rule]:
    """A rule for each tool's own permission, and then the overrides, which win."""
    return [Rule(tool, "*", action) for tool, action in defaults.items()] + overrides


def decide(rules: list[Rule], tool: Column, pattern: Column) -> Column:
    """The action of the last rule that matches; ``ask`` without one.

    Rules are few and known on the driver, so they become one expression in place of a join.
    """
    out = F.lit("ask")
    for rule in rules:
        out = F.when(tool.rlike(tx.glob_regex(rule.tool)) & pattern.rlike(tx.glob_regex(rule.pattern)), rule.action).otherwise(out)
    return out


def segments(command: Column) -> Column:
    """The commands of a shell line."""
    return F.filter(F.transform(F.split(command, SHELL_PARTS), tx.strip), lambda s: s != "")


def decide_call(rules: list[Rule], tool: Column, pattern: Column, shell: Column) -> Column:
    """The decision for a call; a shell line is judged as a whole and by each of its commands."""
    parts = F.when(shell, F.concat(F.array(pattern), segments(pattern))).otherwise(F.array(pattern))
    level = lambda p: F.array_position(F.array(*map(F.lit, STRICTNESS)), decide(rules, tool, p))
    return F.element_at(F.array(*map(F.lit, STRICTNESS)), F.array_max(F.transform(parts, level)).cast("int"))


def always_scope(pattern: Column, shell: Column) -> Column:
    """What "always" allows: the first word of each command, alone and with arguments; or everything."""
    words = F.array_sort(F.array_distinct(F.transform(segments(pattern), lambda s: F.regexp_extract(s, r"^\S+", 0))))
    return F.when(shell, F.flatten(F.transform(words, lambda w: F.array(w, F.concat(w, F.lit(" *")))))).otherwise(F.array(F.lit("*")))


def validate_args(given: Column, declared: dict[str, dict[str, object]]) -> Column:
    """What is wrong with a call's arguments, a map of strings, or null.

    ``declared`` has for each argument its ``type`` and perhaps ``required`` and ``enum``.
    """
    unknown = F.array_except(F.map_keys(given), F.array(*map(F.lit, declared)))
    out = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown argument "), F.get(unknown, F.lit(0))))
    for name, meta in declared.items():
        value = F.try_element_at(given, F.lit(name))
        if meta.get("required"):
            out = out.when(value.isNull(), f"missing required argument {name}")
        kinds = {"integer": F.trim(value).rlike(r"^[+-]?\d+$"), "number": F.trim(value).try_cast("double").isNotNull(), "boolean": F.lower(F.trim(value)).isin("true", "false", "yes", "no", "1", "0")}
        if meta["type"] in kinds:
            out = out.when(value.isNotNull() & ~kinds[str(meta["type"])], f"{name} must be a {meta['type']}")
        if "enum" in meta:
            out = out.when(value.isNotNull() & ~value.isin(list(meta["enum"])), f"{name} must be one of {', '.join(map(str, meta['enum']))}")  # type: ignore[call-overload]
    return out


def coerce_args(given: Column, declared: dict[str, dict[str, object]]) -> Column:
    """A call's arguments, a map of strings, as a struct with a typed field per declared argument.

    Arguments that are not given, or that ``validate_args`` refuses, are null.
    """

    def typed(name: str, kind: object) -> Column:
        value = F.try_element_at(given, F.lit(name))
        plain = F.trim(value)
        if kind == "integer":
            return plain.try_cast("long")
        if kind == "number":
            return plain.try_cast("double")
        if kind == "boolean":
            return F.when(F.lower(plain).isin("true", "yes", "1"), True).when(F.lower(plain).isin("false", "no", "0"), False)
        return value

    return F.struct(*(typed(name, meta["type"]).alias(name) for name, meta in declared.items()))


def validate_event(event: Column, required: dict[str, list[str]], enums: dict[str, dict[str, list[str]]], allowed: dict[str, list[str]] | None = None) -> Column:
    """What is wrong with an event, a map of strings with ``type``, or null.

    Events of the types in ``allowed`` may have no fields but those listed there and the required ones.
    """
    kind = F.try_element_at(event, F.lit("type"))
    out = F.when(kind.isNull() | ~kind.isin(list(required)), F.lit("unknown type"))
    for name, fields in required.items():
        missing = F.array_except(F.array(*map(F.lit, fields)), F.map_keys(event))
        out = out.when((kind == name) & (F.size(missing) > 0), F.concat(F.lit("missing field "), F.get(missing, F.lit(0))))
        for field, values in enums.get(name, {}).items():
            out = out.when((kind == name) & ~F.try_element_at(event, F.lit(field)).isin(values), f"{field} must be one of {', '.join(values)}")
    for name, fields in (allowed or {}).items():
        unknown = F.array_sort(F.array_except(F.map_keys(event), F.array(*map(F.lit, ["type", *required.get(name, []), *fields]))))
        out = out.when((kind == name) & (F.size(unknown) > 0), F.concat(F.lit("unknown field "), F.array_join(unknown, ", ")))
    return out


def answered(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")) != ""


def needs_review(answer: Column, mode: Column, used_tools: Column) -> Column:
    return answered(answer) & ((mode == "always") | ((mode == "auto") & used_tools))


def verdict(review: Column) -> Column:
    """``pass``, ``blocked`` or null by how a review begins."""
    begins = F.upper(tx.strip(review))
    return F.when(begins.startswith("VERDICT: PASS"), "pass").when(begins.startswith("VERDICT: BLOCKED"), "blocked")


def no_progress(repeats: Column, most: int) -> Column:
    return repeats >= most
