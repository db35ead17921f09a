"""Experiments on disk: settings, folders, manifests and logs. Small files of the driver; tables go through Spark."""

from __future__ import annotations

import json
import logging
import re
import subprocess
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime
from pathlib import Path

#: The columns of the ledger of experiments.
LEDGER = ("exp_id", "date", "git_sha", "wandb_url", "cv_metric", "cv_mean", "cv_std", "lb_public", "lb_private", "data_rev", "seed", "n_splits", "cv_method", "split_id", "notes", "submission_id", "submitted_at")


@dataclass(frozen=True)
class Settings:
    """Where the tables are and how the model is fitted. data_dir is relative to the settings file."""

    data_dir: str = "data"
    actions: str = "action_data.csv"
    train: str = "match_train_data.csv"
    test: str = "match_test_data.csv"
    folds: int = 5
    seed: int = 42
    threshold: float = 0.1
    pos_weight: float = 5.0
    rounds: int = 20
    depth: int = 4
    rate: float = 0.1
    kinds: tuple[str, ...] = ("pass", "cross", "carry", "dribble", "shot", "tackle", "interception", "clearance")
    notes: str = ""
    extra: dict = field(default_factory=dict)

    @classmethod
    def of(cls, given: dict) -> Settings:
        """Known names are taken, others are kept in extra."""
        names = {f.name for f in fields(cls)} - {"extra"}
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in names}
        return cls(**known, extra={k: v for k, v in given.items() if k not in names})

    def paths(self) -> dict[str, str]:
        return {k: str(Path(self.data_dir) / getattr(self, k)) for k in ("actions", "train", "test")}


def load_settings(path: str) -> Settings:
    """From a JSON file, or a YAML one where a YAML reader is installed."""
    p = Path(path)
    if p.suffix in (".yaml", ".yml"):
        import yaml

        given = yaml.safe_load(p.read_text())
    else:
        given = json.loads(p.read_text())
    s = Settings.of(given or {})
    return Settings(**{**asdict(s), "kinds": tuple(s.kinds), "data_dir": str((p.parent / s.data_dir).resolve())})


def next_experiment(folder: str) -> str:
    """expNNNN after the last one of the folder."""
    have = [int(m[1]) for p in Path(folder).glob("exp*") if (m := re.fullmatch(r"exp(\d{4})", p.name))]
    return f"exp{max(have, default=0) + 1:04d}"


def missing_parts(folder: str, wanted: tuple[str, ...] = ("metrics.json",)) -> list[str]:
    return [w for w in wanted if not (Path(folder) / w).exists()]


def git_revision(folder: str = ".") -> str:
    done = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else "unknown"


def manifest(exp_id: str, settings: Settings, metrics: dict, folder: str = ".") -> dict:
    return {"exp_id": exp_id, "created": datetime.now(UTC).isoformat(timespec="seconds"), "revision": git_revision(folder), "settings": asdict(settings), "metrics": metrics}


def experiment_log(path: str) -> logging.Logger:
    """A logger that appends to the file."""
    log = logging.getLogger(f"fieldloom.{path}")
    if not log.handlers:
        handler = logging.FileHandler(path)
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log
