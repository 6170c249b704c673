"""Unit corrections by vendor. Where no case fits, samples and units stay; a second correction does nothing."""

from __future__ import annotations

import re
from dataclasses import replace

from lumenspan.model import Record
from lumenspan.operators.space import difference
from lumenspan.operators.timeaxis import scale

#: Fixed values of the instruments: strain per radian and counts per radian of Silixa; BAM radian per microstrain.
SILIXA_STRAIN, SILIXA_BITS, BAM_MICROSTRAIN = 116e-9, 13, 18.4


def instr_correct(record: Record, target: str = "strain-rate") -> Record:
    meta = record.meta
    done = {"units": target, "corrected": True}
    if meta.corrected:
        return record
    rate = SILIXA_STRAIN * meta.fs / meta.gauge_length
    if meta.company == "silixa" and meta.units == "counts" and target == "strain-rate":
        return scale(record, rate / 2**SILIXA_BITS, **done)
    if meta.company == "bam" and meta.format == "npz" and meta.units == "counts" and target == "strain":
        return scale(record, 1e-6 / BAM_MICROSTRAIN, **done)
    if meta.company == "terra15" and meta.units == "m/s" and target == "strain-rate":
        step = int(round(meta.gauge_length / meta.spatial_interval))
        return difference(record, step, step * meta.spatial_interval, **done)
    if meta.company == "asn" and meta.units == "rad/(strain*m)" and target == "strain-rate":
        return scale(record, 1 / meta.conv_factor, **done)
    if meta.company == "quantx" and target == "strain-rate":
        scaled = re.search(r"(\d)\^(\d\d)$", meta.units or "")
        if not scaled:
            raise ValueError("QuantX units must end in a base and an exponent, as in 2^16")
        return scale(record, rate / int(scaled[1]) ** int(scaled[2]), **done)
    return Record(record.traces, replace(meta))
