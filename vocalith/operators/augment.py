"""Recipes of augmentations: steps over a clip's samples, with what each step drew and measured.

A step is a registered function of the sound and what was drawn for it; it returns the new sound and what it did. Seeds, sources and the bounds of
speech are columns: which noise or room a clip gets follows from its seed, by a join on a number, so sources stay a table, however large. The
steps of a recipe run in one Arrow UDF, as their samples needn't leave it in between.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.functions.audio import bandpass, decode_mulaw, encode_mulaw, mix, noise_part, resampled, reverberate

_PHONE = [{"kind": "resample", "rate": 8000}, {"kind": "bandpass", "low_hz": 300, "high_hz": 3400, "sections": 2}, {"kind": "mulaw"}]
#: The recipes that are used by name.
RECIPES = {
    "telephony_mulaw": [_PHONE[0], _PHONE[2]],
    "telephony_g712": _PHONE,
    **{f"noise_snr{n}": [{"kind": "noise", "snr_db": n}] for n in (20, 10, 5, 0)},
    "reverb": [{"kind": "reverb"}],
    **{f"phone_noisy_snr{n}": [{"kind": "noise", "snr_db": n}, *_PHONE] for n in (10, 5)},
}
OUT = "struct<samples:binary,rate:int,augmentation:array<struct<kind:string,params:string,seed:bigint>>>"


@dataclass(frozen=True)
class Sound:
    """Samples at a rate, and the seconds in which there is speech; both bounds null where nothing is known."""

    samples: np.ndarray
    rate: int
    speech: tuple[float | None, float | None] = (None, None)

    def region(self) -> tuple[int, int]:
        """Speech in samples: within the clip, and never empty."""
        n = self.samples.size
        if None in self.speech:
            return 0, n
        a, z = (int(v) for v in np.clip(np.rint(np.array(self.speech) * self.rate), (0, 1), (n - 1, n)))
        return a, max(z, a + 1)

    def said(self) -> dict:
        """What a step that measures speech tells of the place where it did."""
        return {"region": "whole_clip" if None in self.speech else "vad", "region_s": [round(i / self.rate, 4) for i in self.region()]}


@dataclass(frozen=True)
class Drawn:
    """What a step has besides the sound: its parameters, its seed, and a source with its name where it takes one."""

    params: dict
    seed: int
    name: str | None = None
    source: Sound | None = None


@dataclass(frozen=True)
class Step:
    run: Callable[[Sound, Drawn], tuple[Sound, dict]]
    params: frozenset[str]
    sources: str | None


STEPS: dict[str, Step] = {}


def step(*params: str, sources: str | None = None, name: str | None = None) -> Callable:
    """Register a step under its function's name or another one; ``sources`` names the table that it draws from."""

    def register(f: Callable) -> Callable:
        STEPS[name or f.__name__] = Step(f, frozenset(params), sources)
        return f

    return register


@step("rate")
def resample(sound: Sound, drawn: Drawn) -> tuple[Sound, dict]:
    to = drawn.params["rate"]
    return replace(sound, samples=resampled(sound.samples, sound.rate, to), rate=to), {"rate_in": sound.rate, "rate_out": to}


@step("low_hz", "high_hz", "sections", name="bandpass")
def band(sound: Sound, drawn: Drawn) -> tuple[Sound, dict]:
    p = drawn.params
    return replace(sound, samples=bandpass(sound.samples, sound.rate, p["low_hz"], p["high_hz"], p.get("sections", 2))), {"rate": sound.rate, **p}


@step()
def mulaw(sound: Sound, drawn: Drawn) -> tuple[Sound, dict]:
    return replace(sound, samples=decode_mulaw(encode_mulaw(sound.samples))), {"rate": sound.rate}


def _made(sound: Sound, drawn: Drawn, made: dict, **told) -> tuple[Sound, dict]:
    """The sound that a mix or a room made, and how loud."""
    told |= {k: round(v, 8) if isinstance(v, float) else v for k, v in made.items() if k != "samples"}
    return replace(sound, samples=np.frombuffer(made["samples"], "<i2")), {"rate": sound.rate, "file": drawn.name, **sound.said(), **told}


@step("snr_db", sources="noises")
def noise(sound: Sound, drawn: Drawn) -> tuple[Sound, dict]:
    whole = resampled(drawn.source.samples, drawn.source.rate, sound.rate)
    part, at = noise_part(whole, sound.samples.size, np.random.default_rng(drawn.seed))
    return _made(sound, drawn, mix(sound.samples, part, drawn.params["snr_db"], *sound.region()), offset=at, tiled=whole.size < sound.samples.size, **drawn.params)


@step(sources="rooms")
def reverb(sound: Sound, drawn: Drawn) -> tuple[Sound, dict]:
    room = resampled(drawn.source.samples, drawn.source.rate, sound.rate)
    return _made(sound, drawn, reverberate(sound.samples, room, *sound.region()))


def checked(steps: Sequence[dict]) -> list[dict]:
    """The steps, if all are registered and have no other parameters than theirs; opus needs an outside codec and isn't."""
    for s in steps:
        if s.get("kind") not in STEPS:
            raise ValueError(f"unknown step: {s.get('kind')}")
        if odd := set(s) - {"kind"} - STEPS[s["kind"]].params:
            raise ValueError(f"{s['kind']} has no {sorted(odd)}")
    return list(steps)


def step_seed(run_seed: int, utt_id: Column, index: int) -> Column:
    """The first 8 bytes of SHA-256 of run, utterance and step, as a number of 63 bits."""
    digest = F.sha2(F.concat(F.lit(f"{run_seed}:"), utt_id, F.lit(f":{index}")), 256)
    return F.shiftrightunsigned(F.conv(F.substring(digest, 1, 16), 16, -10).cast("long"), 1)


def applied(sound: Sound, steps: Sequence[dict], drawn: Sequence[tuple[int, str | None, Sound | None]]) -> tuple[Sound, list[dict]]:
    """The sound after all steps, and their record."""
    record = []
    for s, (seed, name, source) in zip(steps, drawn):
        params = {k: v for k, v in s.items() if k != "kind"}
        sound, told = STEPS[s["kind"]].run(sound, Drawn(params, seed, name, source))
        record.append({"kind": s["kind"], "params": json.dumps(told, sort_keys=True), "seed": seed})
    return sound, record


def _with_source(rows: DataFrame, table: DataFrame, seed: str, into: str) -> DataFrame:
    """``rows`` with the source that their seed says, of those in order of name. Only names are put in order."""
    names = table.select("name").withColumn("_at", F.row_number().over(Window.orderBy("name")) - 1)
    n = table.count()
    if not n:
        raise ValueError("there are no sources")
    sources = table.join(names, "name").select("_at", F.struct("name", "samples", "rate").alias(into))
    return rows.withColumn("_at", F.pmod(F.col(seed), F.lit(n))).join(sources, "_at").drop("_at")


def augmented(clips: DataFrame, recipe: str, steps: Sequence[dict] | None = None, run_seed: int = 0, noises: DataFrame | None = None, rooms: DataFrame | None = None) -> DataFrame:
    """Child rows of ``clips`` (utt_id, samples, rate, start_s, end_s): (utt_id, parent_utt_id, samples, rate, augmentation).

    ``noises`` and ``rooms`` are tables (name, samples, rate) of different names.
    """
    steps = checked(RECIPES[recipe] if steps is None else steps)
    tables = {"noises": noises, "rooms": rooms}
    bound = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    known = bound("start_s").isNotNull() & bound("end_s").isNotNull()
    rows = clips.select("utt_id", "samples", "rate", *[F.when(known, bound(c)).alias(c) for c in ("start_s", "end_s")])
    for i, s in enumerate(steps):
        rows = rows.withColumn(f"seed{i}", step_seed(run_seed, F.col("utt_id"), i))
        wanted = STEPS[s["kind"]].sources
        if wanted is None:
            rows = rows.withColumn(f"source{i}", F.lit(None).cast("struct<name:string,samples:binary,rate:int>"))
        elif tables[wanted] is None:
            raise ValueError(f"{recipe} needs {wanted}")
        else:
            rows = _with_source(rows, tables[wanted], f"seed{i}", f"source{i}")
    columns = [c for i in range(len(steps)) for c in (F.col(f"seed{i}"), F.col(f"source{i}.name"), F.col(f"source{i}.samples"), F.col(f"source{i}.rate"))]
    sound = lambda data, rate, speech=(None, None): Sound(np.frombuffer(bytes(data), "<i2"), int(rate), speech)

    @F.pandas_udf(OUT)
    def run(samples: pd.Series, rate: pd.Series, start: pd.Series, end: pd.Series, *drawn: pd.Series) -> pd.DataFrame:
        out = []
        for data, hz, a, z, *rest in zip(samples, rate, start, end, *drawn):
            speech = (None, None) if pd.isna(a) else (float(a), float(z))
            parts = [(int(seed), name, None if name is None else sound(x, r)) for seed, name, x, r in zip(*[iter(rest)] * 4)]
            made, record = applied(sound(data, hz, speech), steps, parts)
            out.append((made.samples.astype("<i2").tobytes(), made.rate, record))
        return pd.DataFrame(out, columns=["samples", "rate", "augmentation"])

    made = rows.select("utt_id", run("samples", "rate", "start_s", "end_s", *columns).alias("a"))
    return made.select(F.concat("utt_id", F.lit(f"#{recipe}")).alias("utt_id"), F.col("utt_id").alias("parent_utt_id"), "a.*")
