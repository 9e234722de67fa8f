"""Collections: which fields of their documents play which role."""

from __future__ import annotations

from dataclasses import dataclass, field

ALL = "*"
#: Types that a declared field may have, as Spark spells them.
TYPES = ("string", "bigint", "double", "boolean", "date", "timestamp", "array<string>", "array<bigint>", "array<double>")


@dataclass(frozen=True)
class CollectionSpec:
    """Roles of fields. Searchable fields come in the order of their weight in ranking; "*" as the
    only field means all. types gives the types of fields of the documents; without one, a field is a
    string. The field "id" is always the id of the document."""

    name: str
    searchable: tuple[str, ...] = (ALL,)
    filterable: tuple[str, ...] = ()
    sortable: tuple[str, ...] = ()
    returnable: tuple[str, ...] = (ALL,)
    semantic: tuple[str, ...] = ()
    semantic_weights: dict[str, float] = field(default_factory=dict)
    embedder: str = ""
    types: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise ValueError("a collection needs a name")
        for role in ("searchable", "filterable", "sortable", "returnable", "semantic"):
            fields = getattr(self, role)
            if len(set(fields)) < len(fields) or any(not f.strip() for f in fields):
                raise ValueError(f"{self.name}: fields of {role} must be different and not empty")
        wrong = {f: t for f, t in self.types.items() if t not in TYPES or f in ("id", ALL)}
        if wrong:
            raise ValueError(f"{self.name}: types that can't be: {wrong}")

    def declared(self) -> dict[str, str]:
        """Types of the fields that can be filtered or sorted by, the id left out."""
        fields = dict.fromkeys((*self.filterable, *self.sortable))
        return {f: self.types.get(f, "string") for f in fields if f not in ("id", ALL)}


def by_name(specs: list[CollectionSpec]) -> dict[str, CollectionSpec]:
    """Collections by name; each name once."""
    found = {s.name: s for s in specs}
    if len(found) < len(specs):
        raise ValueError("collection names must be different")
    return found
