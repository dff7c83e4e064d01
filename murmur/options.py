"""Options of a transcription run, with one preset per kind of request."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class PipelineOptions:
    """One field per request flag. ``compat`` keeps the historical quirks that FIXTURES.md lists."""

    keep_raw: bool = True
    do_echo_clearing: bool = False
    do_dialogue: bool = False
    do_punctuation: bool = False
    do_diarization: bool = False
    make_mono: bool = False
    do_speed_correction: bool = True
    speed_multiplier: float = 1.0
    num_speakers: int = -1
    between_words_percentile: float = 80.0
    max_chunk_ms: int = 30_000
    echo_delta_ms: int = 900
    echo_similarity: float = 0.8
    max_pause_ms: int = 2_000
    min_overlap: float = 0.5
    compat: bool = False

    def __post_init__(self):
        if not 0 < self.speed_multiplier <= 1:
            raise ValueError("speed_multiplier lies in (0, 1]")
        if not 0 <= self.between_words_percentile <= 100:
            raise ValueError("between_words_percentile lies in [0, 100]")

    def using(self, **changes) -> PipelineOptions:
        return replace(self, **changes)


def from_environment(values: dict[str, str], prefix: str = "MURMUR_", base: PipelineOptions | None = None) -> PipelineOptions:
    """Options from texts such as environment variables: MURMUR_DO_DIALOGUE=1 and so on; whole numbers of at least one
    are true. Names that aren't options are passed over; a text that is no number where one is wanted raises."""
    base, changes = base or PipelineOptions(), {}
    for name, now in base.__dict__.items():
        text = values.get(prefix + name.upper())
        if text is not None:
            changes[name] = int(text) >= 1 if isinstance(now, bool) else type(now)(text)
    return base.using(**changes)


UPLOAD = PipelineOptions(do_speed_correction=False)
URL = PipelineOptions(do_echo_clearing=True)
FOLDER = PipelineOptions(do_echo_clearing=True, do_dialogue=True, keep_raw=False)
