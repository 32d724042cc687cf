"""Settings of a run, from Python or a command line, and the named data sets."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class JoinConfig:
    """Sizes in rows, rates in rows a second. A path takes the place of a generated stream."""

    alg: str = "SHJ-L0"
    r_size: int = 1_000_000
    s_size: int = 1_000_000
    r_rate: int = 1000
    s_rate: int = 1000
    r_window: int = 1_000_000
    s_window: int = 1_000_000
    r_batch: int = 0
    s_batch: int = 0
    r_path: str = ""
    s_path: str = ""
    r_seed: int = 11111
    s_seed: int = 22222
    skew: float = 0.0
    nthreads: int = 1
    fk_join: bool = False
    self_join: bool = False
    no_sgx: bool = False
    csv: bool = False
    duplicates: str = "raise"

    def __post_init__(self) -> None:
        for name in ("r_size", "s_size", "r_rate", "s_rate", "r_window", "s_window", "nthreads"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        for name in ("r_batch", "s_batch", "skew"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")

    @property
    def window(self) -> tuple[int, int]:
        return self.r_window, self.s_window

    @property
    def batch(self) -> tuple[int, int]:
        return self.r_batch, self.s_batch

    @classmethod
    def from_args(cls, argv: Sequence[str]) -> JoinConfig:
        """``--r-window 100 --fk-join ...``: an option for each setting; --dataset sets several, which others then override."""
        parser = argparse.ArgumentParser(prog="braidwin")
        parser.add_argument("--dataset", choices=sorted(DATASETS))
        for f in fields(cls):
            name = "--" + f.name.replace("_", "-")
            if isinstance(f.default, bool):
                parser.add_argument(name, action="store_const", const=True)
            else:
                parser.add_argument(name, type=type(f.default))
        given = {k: v for k, v in vars(parser.parse_args(list(argv))).items() if v is not None}
        base = DATASETS[given.pop("dataset")] if "dataset" in given else cls()
        return replace(base, **given)


#: Sizes, rates, windows and batches of the named data sets.
DATASETS = {
    "synth-1": JoinConfig(r_size=2_000_000, s_size=2_000_000, r_rate=1024, s_rate=1024, r_window=65_536, s_window=65_536, r_batch=1024, s_batch=1024, fk_join=True),
    "synth-2": JoinConfig(r_size=2_000_000, s_size=2_000_000, r_rate=1024, s_rate=4096, r_window=65_536, s_window=65_536, r_batch=1024, s_batch=4096, fk_join=True),
    "tpch-1": JoinConfig(r_size=150_000, s_size=1_500_000, r_rate=1024, s_rate=4096, r_window=65_536, s_window=65_536, r_batch=1024, s_batch=4096, r_path="data/customer.tbl", s_path="data/orders.tbl", fk_join=True),
}
