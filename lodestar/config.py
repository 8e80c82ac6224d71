"""Settings with named profiles. A profile that changes the model must change the index too."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field


def merged(base: Mapping, over: Mapping) -> dict:
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


@dataclass(frozen=True)
class Config:
    settings: dict
    profile: str | None = None

    @property
    def model(self) -> str:
        return self.settings["models"]["embedding"]

    @property
    def index(self) -> str:
        return self.settings["index"]["name"]


@dataclass
class Profiles:
    base: dict
    profiles: dict[str, dict] = field(default_factory=dict)

    def load(self, profile: str | None = None, environment: Mapping[str, str] = os.environ) -> Config:
        profile = profile or environment.get("LODESTAR_PROFILE") or None
        if profile is not None and profile not in self.profiles:
            raise KeyError(f"no such profile: {profile}")
        settings = merged(self.base, self.profiles.get(profile, {}))
        if index := environment.get("LODESTAR_INDEX"):
            settings = merged(settings, {"index": {"name": index}})
        config, plain = Config(settings, profile), Config(self.base)
        if config.model != plain.model and config.index == plain.index:
            raise ValueError(f"profile {profile} changes the model but not the index {plain.index}")
        return config


def guard_output(profile: str | None, path: str, baseline: str, run: str | None = None, baseline_run: str | None = None) -> None:
    """A profiled run must not write the baseline's report, nor be logged under the baseline's name."""
    if profile is None:
        return
    if path == baseline:
        raise ValueError(f"a run of profile {profile} would overwrite {baseline}")
    if run is not None and run == baseline_run:
        raise ValueError(f"a run of profile {profile} would be logged as {baseline_run}")


def read_report(path: str) -> dict | None:
    """A report, or None where there is none or what is there is no report."""
    try:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def judged(report: dict) -> int | None:
    n = report.get("judged_answers") or 0
    return n if isinstance(n, int) else int(n) if isinstance(n, (float, str)) and str(n).strip().isdigit() else None


def guard_judgments(path: str, report: dict) -> None:
    """A report must not replace one of the same split with more judged answers. One that can't be read has no count to lose."""
    old = read_report(path)
    if old is None or old.get("split") != report.get("split"):
        return
    before, after = judged(old), judged(report)
    if before is not None and after is not None and after < before:
        raise ValueError(f"{path} has {before} judged answers, the new report {after}")


def independent(generator: Mapping[str, str], judge: Mapping[str, str]) -> bool:
    """Whether a judge is another model than the generator, by the names of backend and model."""
    return any(generator.get(k) != judge.get(k) for k in ("backend", "model"))
