"""Labels an operator can read for feature names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Labels of single features.
LABELS = {
    "fixtype": "Satellite tracking (fix type)",
    "gspeed": "Reported motion (ground speed)",
    "hacc": "Position solution quality (horizontal accuracy)",
    "headacc": "Position solution quality (heading accuracy)",
    "n_sats_l1": "Satellite tracking (L1 satellites)",
    "numsv": "Satellite tracking (satellites used)",
    "pdop": "Position solution quality (geometry quality)",
    "pos_dev_m": "Position solution quality (position deviation)",
    "sacc": "Position solution quality (speed accuracy)",
    "vacc": "Position solution quality (vertical accuracy)",
    "veld": "Reported motion (vertical velocity)",
    "vele": "Reported motion (east velocity)",
    "veln": "Reported motion (north velocity)",
}
# Label of every feature that starts so, what its ending adds in brackets, and what stands there otherwise.
FAMILIES = [
    ("agc_", "Receiver gain control", {"_mean": "mean"}, None),
    ("doppler_", "Doppler consistency", {}, None),
    ("jam_ind_", "Receiver jamming indicator", {"_mean": "mean"}, None),
    ("noise_per_ms_", "Radio noise floor", {"_mean": "mean"}, None),
    ("pr_doppler_", "Doppler consistency", {}, None),
    ("snr_", "Signal-to-noise ratio", {"_mean": "mean", "_min": "minimum", "_std": "variation"}, "value"),
    ("vel", "Reported motion", {}, "velocity"),
]


def plain_name(feature: Column) -> Column:
    """The feature's own label, else its family's, else the name itself in title case."""
    name = F.lower(feature)
    out = F.initcap(F.trim(F.translate(feature, "_", " ")))
    for start, family, endings, other in FAMILIES:
        label = F.lit(f"{family} ({other})" if other else family)
        for ending, detail in endings.items():
            label = F.when(name.endswith(ending), f"{family} ({detail})").otherwise(label)
        out = F.when(name.startswith(start), label).otherwise(out)
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), out)
