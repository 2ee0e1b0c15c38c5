"""Query specs, controls and table schemas of the drill-down model."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import types as T

GLOBAL = "Global"
UNKNOWN = "Unknown"

#: The four baselines left out for their size.
IGNORED_BASELINES = ("i-Institution-Country-Global", "i-Concept-Continent-Institution", "i-Institution-Country-Country", "i-Concept-Country-Institution")
#: What a path's last step is said to be; other kinds have no such words.
DESCRIPTIONS = {
    "Country": "Cited by paper published in",
    "Continent": "Cited by paper published in",
    "Institution": "Cited by paper published by",
    "Concept": "Where the original paper was categorized as",
    "SubConcept": "Where the original paper was categorized as",
}
#: The entity kinds.
ENTITY_KINDS = ("Institution", "Concept", "SubConcept", "Country", "Continent", "InstitutionType", "Period", "Year")
SIZE_BASES = ("volume", "specialization")

NODE = T.StructType().add("spec_id", "string").add("root_id", "string").add("level", "integer").add("path", T.ArrayType(T.StringType())).add("parent_path", T.ArrayType(T.StringType())).add("child_id", "string").add("weight", "double")
LABEL = T.StructType().add("entity_type", "string").add("id", "string").add("name", "string").add("meta", "string")
BASELINE = T.StructType().add("root_type", "string").add("target", "string").add("basis", "string").add("hierarchy", "string").add("basis_id", "string").add("parent_id", "string").add("child_id", "string").add("rate", "double")


@dataclass(frozen=True)
class Basis:
    """What a baseline is relative to: roots of an attribute value, and an ancestor kind."""

    basis: str = GLOBAL
    hierarchy: str = GLOBAL


@dataclass(frozen=True)
class Control:
    """How one level is filtered; immutable, so defaults are never shared by accident."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    limit_n: int = 10
    show_top: bool = True
    size_base: str = "volume"

    @staticmethod
    def merged(template: str | None, default: Control | None = None) -> Control:
        """default with the fields that a JSON template sets; a malformed or null template sets none."""
        default = default or Control()
        try:
            given = json.loads(template) if template else {}
        except ValueError:
            given = {}
        known = {f.name for f in fields(Control)}
        given = {k: tuple(map(str, v)) if isinstance(v, list) else v for k, v in given.items() if k in known} if isinstance(given, dict) else {}
        return replace(default, **given)

    def with_filter(self, kind: str, entity: str) -> Control:
        """An id put at the front of the include or exclude list, once."""
        return replace(self, **{kind: (entity, *(x for x in getattr(self, kind) if x != entity))})

    def without_filter(self, kind: str, entity: str) -> Control:
        return replace(self, **{kind: tuple(x for x in getattr(self, kind) if x != entity)})


@dataclass(frozen=True)
class Level:
    """One group-by level of a spec."""

    attribute_kind: str
    resolver_id: str
    control_template: str = "{}"
    description: str = ""


@dataclass(frozen=True)
class QuerySpec:
    """An ordered list of levels under a kind of root."""

    spec_id: str
    root_kind: str
    levels: tuple[Level, ...]
    title: str = ""
    description: str = ""
    columns: tuple[str, ...] = field(default=())

    @property
    def kinds(self) -> list[str]:
        return [x.attribute_kind for x in self.levels]

    def controls(self) -> list[Control]:
        """Each level's default control."""
        return [Control.merged(x.control_template) for x in self.levels]

    def kind_of(self, length: int) -> str:
        if not 1 <= length <= len(self.levels):
            raise ValueError(f"a path of {self.spec_id} has 1 to {len(self.levels)} steps")
        return self.levels[length - 1].attribute_kind

    def hierarchy_level(self, kind: str, level: int) -> int | None:
        """Level of the nearest strict ancestor of a node at level whose kind it is, counted from 1."""
        return next((i for i in range(level - 1, 0, -1) if self.kinds[i - 1] == kind), None)

    def divisor_level(self, level: int) -> int:
        """Level whose node a global share is taken of: the nearest strict ancestor of the root's kind, never the first level; else the root (0)."""
        return next((i for i in range(level - 1, 1, -1) if self.kinds[i - 1] == self.root_kind), 0)


def fill_placeholder(text: str, entity: str) -> str:
    """Every {pc_id}, in either case, becomes the id."""
    return re.sub(r"\{pc_id\}", lambda _: entity, text, flags=re.I)


def baseline_name(root_kind: str, target: str, basis: Basis) -> str:
    """The stored name of a baseline: root letter, target, basis and hierarchy."""
    return "-".join((root_kind[:1].lower(), target, basis.basis, basis.hierarchy))


#: Which metadata field holds a basis; others go by their own name.
BASIS_FIELDS = {"Continent": "continent__id", "Country": "country__id"}


def basis_field(basis: str) -> str:
    return BASIS_FIELDS.get(basis, basis)
