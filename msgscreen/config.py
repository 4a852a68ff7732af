"""Job configuration; every value is turned into literals of the plan."""

from __future__ import annotations

import os
from dataclasses import dataclass

from .functions import fixed_values as fv
from .operators.secret_rules import DEFAULT_RULES, SecretRule


@dataclass(frozen=True)
class ScreenConfig:
    """Settings of a screening job.

    mode
        ``compat`` redacts recogniser spans first and then replaces supplement
        values literally, with all known quirks of that rule; ``strict`` sends
        every type through the span path, so a value that overlaps another one
        or a token typed by the user cannot leave a name in clear.
    recognizers
        Names of span recognisers used ahead of the supplement in ``compat``
        mode, and on top of the standard ones in ``strict`` mode.
    pii_threshold
        Accepted for compatibility of configuration; spans are cut at
        ``span_score_threshold``.
    secret_rules
        Credential rules beside the published patterns; an empty tuple switches them off.
    lexicon_in_row
        Whether toxicity words are looked up inside each row, without a shuffle, or
        by a join. By default the size of the lexicon decides; True refuses a large
        one, False always joins.
    """

    injection_threshold: float = fv.INJECTION_THRESHOLD
    toxicity_threshold: float = fv.TOXICITY_THRESHOLD
    pii_threshold: float = fv.PII_THRESHOLD
    span_score_threshold: float = fv.SPAN_SCORE_THRESHOLD
    max_message_chars: int = fv.MAX_MESSAGE_CHARS
    model_input_chars: int = fv.MODEL_INPUT_CHARS
    mode: str = "compat"
    recognizers: tuple[str, ...] = ()
    injection_rules: tuple[tuple[str, str, float], ...] = fv.INJECTION_RULES
    extra_secret_rules: tuple[tuple[str, str, float], ...] = ()
    secret_rules: tuple[SecretRule, ...] = DEFAULT_RULES
    lexicon_in_row: bool | None = None

    def __post_init__(self):
        if self.mode not in ("compat", "strict"):
            raise ValueError(f"mode must be 'compat' or 'strict', not {self.mode!r}")

    @classmethod
    def from_env(cls, **overrides) -> "ScreenConfig":
        """Thresholds from the driver's environment, as deployments set them."""
        values = {
            "injection_threshold": float(os.getenv("INJECTION_THRESHOLD", fv.INJECTION_THRESHOLD)),
            "toxicity_threshold": float(os.getenv("TOXICITY_THRESHOLD", fv.TOXICITY_THRESHOLD)),
            "pii_threshold": float(os.getenv("PII_THRESHOLD", fv.PII_THRESHOLD)),
        }
        return cls(**{**values, **overrides})
