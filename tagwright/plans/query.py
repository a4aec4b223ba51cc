"""What a query asks for, checked before anything is planned."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum

#: The pseudo-tag of every post.
ALL = "_ALL_TAGS_"
OPERATORS = ("AND", "AND-NOT", "OR", "OR-NOT")
MAX_PAGE = 250


class Sort(Enum):
    LAST_ACTIVITY = "last_activity_date"
    CREATION = "creation_date"
    SCORE = "score"
    VIEWS = "view_count"
    ANSWERS = "answer_count"

    @property
    def column(self) -> str:
        return self.value

    @property
    def is_date(self) -> bool:
        return self.value.endswith("_date")

    @classmethod
    def parse(cls, text: str) -> Sort:
        for s in cls:
            if text.lower().replace("_", "") in (s.value.replace("_", ""), s.name.lower().replace("_", "")):
                return s
        raise ValueError(f"no sort order named {text!r}")


@dataclass(frozen=True)
class TagQuery:
    """A page of posts. mode: ``set`` gives set results in global order; ``interleave`` zips the two lists of OR and OR-NOT and ends with the shorter one."""

    tag: str
    sort: Sort = Sort.VIEWS
    page_size: int = 25
    skip: int = 0
    other_tag: str | None = None
    operator: str = "AND"
    exclusions: tuple[str, ...] = field(default=())
    mode: str = "set"

    def __post_init__(self):
        for name in ("tag", "other_tag"):
            value = getattr(self, name)
            if value is not None and not value.strip() or name == "tag" and value is None:
                raise ValueError(f"{name} is blank")
        if not 1 <= self.page_size <= MAX_PAGE:
            raise ValueError(f"page_size {self.page_size} isn't within 1 and {MAX_PAGE}")
        if self.operator not in OPERATORS:
            raise ValueError(f"operator {self.operator!r} is none of {', '.join(OPERATORS)}")
        if self.mode not in ("set", "interleave"):
            raise ValueError(f"mode {self.mode!r} is neither set nor interleave")

    @property
    def offset(self) -> int:
        return max(0, self.skip)

    @classmethod
    def from_params(cls, tag: str, params: Mapping[str, str], exclusions: tuple[str, ...] = ()) -> TagQuery:
        """From request parameters, whose names count in either case."""
        p = {k.lower(): v for k, v in params.items()}
        return cls(
            tag,
            Sort.parse(text_param(p, "type", "ViewCount")),
            int_param(p, "pagesize", 50),
            int_param(p, "skip", 0),
            text_param(p, "othertag", "") or None,
            text_param(p, "operator", "AND"),
            exclusions,
            "interleave" if bool_param(p, "interleave", False) else "set",
        )


def text_param(params: Mapping[str, str], name: str, default: str) -> str:
    return {k.lower(): v for k, v in params.items()}.get(name.lower(), default)


def int_param(params: Mapping[str, str], name: str, default: int) -> int:
    try:
        return int(text_param(params, name, str(default)))
    except ValueError:
        return default


def bool_param(params: Mapping[str, str], name: str, default: bool) -> bool:
    """A name without a value is true; what is neither true nor false is the default."""
    value = text_param(params, name, str(default)).lower()
    return True if value == "" else {"true": True, "false": False}.get(value, default)
