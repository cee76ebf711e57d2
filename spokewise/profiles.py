"""Rider profiles: how much each kind of discomfort weighs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Profile:
    name: str
    max_lts: int
    stress_budget_m: float
    weight_lts: float
    weight_crash: float
    weight_surface: float
    weight_grade: float
    weight_lighting: float
    weight_turn: float
    weight_hazard: float
    max_detour: float

    def problems(self) -> list[str]:
        """What is out of range; empty for a usable profile."""
        out = []
        if not 1 <= self.max_lts <= 4:
            out.append("max_lts must be from 1 to 4")
        if not 0 <= self.stress_budget_m <= 20_000:
            out.append("stress_budget_m must be from 0 to 20000")
        if not 1 <= self.max_detour <= 10:
            out.append("max_detour must be from 1 to 10")
        out += [f"{k} must be from 0 to 10" for k, v in asdict(self).items() if k.startswith("weight_") and not 0 <= v <= 10]
        return out


# The named profiles, in the order of the fields above.
PROFILES = {
    p.name: p
    for p in (
        Profile("cautious", 2, 400.0, 1.5, 1.2, 1.0, 1.2, 1.0, 1.5, 1.5, 2.5),
        Profile("comfortable", 3, 800.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.8),
        Profile("confident", 4, 2000.0, 0.35, 0.6, 0.5, 0.6, 0.5, 0.5, 0.6, 1.35),
        Profile("shortest", 4, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0),
    )
}
DEFAULT = "comfortable"


def resolve(name: str | None = None, custom: dict | None = None) -> Profile:
    """A named profile, or ``custom`` in its place; raises ``ValueError`` for an unknown or unusable one."""
    if custom:
        profile = replace(PROFILES["shortest"], name="custom", **custom)
    else:
        profile = PROFILES.get(name or DEFAULT)
        if profile is None:
            raise ValueError(f"unknown profile {name!r}; known are {', '.join(sorted(PROFILES))}")
    if found := profile.problems():
        raise ValueError("; ".join(found))
    return profile
