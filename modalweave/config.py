"""Run configuration and its checks."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field, replace

# The class map and the columns of the metadata table.
CLASSES = {"BP": 0, "EryP": 1, "MoP": 2, "NeuP": 3}
META_COLUMNS = ["cell_id", "day", "donor", "technology", "cell_type"]
META_KEYS = ["cell_id", "day", "donor", "technology"]

MODELS = ("dynamic", "static")


@dataclass(frozen=True)
class Config:
    """Options of one experiment.

    ``feature_import_loss`` / ``modality_import_loss`` set to ``None`` remove the
    feature gate / the confidence from the model; ``0`` keeps the part and drops
    only its loss term. The modalities in ``masked`` are replaced by ``mask_value`` when a model is tested,
    and only then; those in ``flipped`` are images of ``image_shape`` (channels, rows, columns) that are mirrored at random,
    each way with probability 1/2, when a model is trained, and only then. An epoch of a fold takes ``ceil(train rows / batch_size)`` steps.
    """

    root: str = ""
    results: str = ""
    image_dir: str | None = None
    modalities: tuple[str, ...] = ("protein", "rna")
    hidden_dims: tuple[int, ...] = (35, 250)
    model: str = "static"
    modality_weights: tuple[float, ...] = (1.0,)
    classification_loss_weight: float = 1.0
    feature_import_loss: float | None = 1.0
    modality_import_loss: float | None = 1.0
    epochs: int = 250
    batch_size: int = 1024
    test_interval: int = 10
    learning_rate: float = 1e-4
    weight_decay: float = 1e-4
    lr_step: int = 500
    lr_gamma: float = 0.2
    dropout: float = 0.5
    seed: int = 42
    val_fraction: float = 0.2
    classes: dict[str, int] = field(default_factory=lambda: dict(CLASSES))
    class_weighted: bool = True
    detach_tcp: bool = False
    keep: str = "best"
    weights_dir: str | None = None
    test_only: bool = False
    masked: tuple[str, ...] = ()
    mask_value: float = 0.5
    flipped: tuple[str, ...] = ()
    image_shape: tuple[int, int, int] = (3, 8, 8)

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"model must be one of {MODELS}, got {self.model!r}")
        if self.keep not in ("best", "last"):
            raise ValueError("keep must be 'best' or 'last'")
        if not self.modalities:
            raise ValueError("at least one modality is needed")
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        if not 0.0 <= self.dropout < 1.0:
            raise ValueError("dropout must be in [0, 1)")
        for name in (*self.masked, *self.flipped):
            if name not in self.modalities:
                raise ValueError(f"{name!r} is none of the modalities {self.modalities}")
        per_view(self.hidden_dims, len(self.modalities), "hidden_dims")
        if self.model == "static":
            per_view(self.modality_weights, len(self.modalities), "modality_weights")

    @property
    def n_classes(self) -> int:
        return len(self.classes)

    @property
    def hidden(self) -> tuple[int, ...]:
        return per_view(self.hidden_dims, len(self.modalities), "hidden_dims")

    @property
    def view_weights(self) -> tuple[float, ...]:
        if self.model == "dynamic":
            return (1.0,) * len(self.modalities)
        return per_view(self.modality_weights, len(self.modalities), "modality_weights")

    @property
    def gated(self) -> bool:
        return self.model == "dynamic" and self.feature_import_loss is not None

    @property
    def confident(self) -> bool:
        return self.model == "dynamic" and self.modality_import_loss is not None

    @property
    def run_name(self) -> str:
        return run_name(self)

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


def per_view(values, n_views: int, what: str) -> tuple:
    """One value per modality; a single value is repeated."""
    values = tuple(values)
    if len(values) == n_views:
        return values
    if len(values) == 1:
        return values * n_views
    raise ValueError(f"{what}: {len(values)} values for {n_views} modalities; give 1 or {n_views}")


def check_pairwise(modalities) -> None:
    """Co-attention pairs at most two modalities."""
    if len(modalities) > 2:
        raise ValueError(f"pairwise fusion takes at most 2 modalities, got {len(modalities)}")


def run_name(cfg: Config) -> str:
    """Name of a run: the main options, and a digest of all options but where results and parameters lie."""
    left_out = ["results", "weights_dir", "test_only"]
    # Options that do nothing leave the names of earlier runs as they are.
    left_out += ["masked", "mask_value"] * (not cfg.masked) + ["flipped", "image_shape"] * (not cfg.flipped)
    options = sorted((k, v) for k, v in asdict(cfg).items() if k not in left_out)
    digest = hashlib.sha256(repr(options).encode()).hexdigest()[:12]
    parts = [
        "run",
        "+".join(cfg.modalities),
        "hid" + "-".join(str(h) for h in cfg.hidden_dims),
        f"ep{cfg.epochs}",
        cfg.model,
        "mw" + "-".join(f"{w:g}" for w in cfg.modality_weights),
        f"cls{cfg.classification_loss_weight:g}",
        "feat" + ("off" if cfg.feature_import_loss is None else f"{cfg.feature_import_loss:g}"),
        "mod" + ("off" if cfg.modality_import_loss is None else f"{cfg.modality_import_loss:g}"),
        f"bs{cfg.batch_size}",
        f"lr{cfg.learning_rate:g}",
        f"seed{cfg.seed}",
        digest,
    ]
    return "_".join(parts)
