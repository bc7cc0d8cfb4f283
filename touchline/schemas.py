"""Fixed values of matches and pitches."""

from __future__ import annotations

#: Segment types that count as play; the others are halftime, pre_match and post_match.
MATCH_TYPES = ("first_half", "second_half", "match", "full_match")
PITCH_LENGTH, PITCH_WIDTH = 120.0, 70.0  # metres
