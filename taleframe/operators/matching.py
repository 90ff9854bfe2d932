"""Finding the same entity in several frames from embeddings, and faces for people."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleframe.functions import geometry
from taleframe.operators.detections import face_in_mask

#: similarity and spread are the mean and deviation that a match has from the admission of this member on; 0 for its first.
MATCHED = "story bigint, label string, match int, member int, frame int, pos bigint, similarity double, spread double, face_similarity double, face_spread double"
PERSON = "person"


def _unit(vectors: pd.Series) -> np.ndarray:
    e = np.stack([np.asarray(x, dtype=np.float64) for x in vectors])
    return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)


def _faces(pdf: pd.DataFrame) -> np.ndarray | None:
    """Face vectors of people, rows of NaN where none is seen; None if nobody in the group shows a face."""
    if "face" not in pdf or str(pdf["label"].iloc[0]).lower() != PERSON or not pdf["face"].notna().any():
        return None
    width = len(next(x for x in pdf["face"] if x is not None))
    return np.stack([np.full(width, np.nan) if x is None else np.asarray(x, dtype=np.float64) for x in pdf["face"]])


class _OpenMatch:
    """A match while it grows: its members' similarities with all of the group, and what its last admission left."""

    def __init__(self, images: np.ndarray, faces: np.ndarray | None, most: int) -> None:
        self.images, self.faces, self.n = images, faces, 0
        self.seen = np.empty((most, len(images)))  # a frame gives one member at most
        self.known = np.empty((most, len(images))) if faces is not None else None
        self.state, self.face_state = (0.0, 0.0), (None, None)

    def add(self, i: int) -> None:
        """Take ``i``: the state is that of its own similarities with the members before it."""
        if self.n:
            self.state = self._told(self.seen[: self.n, i])
            if self.known is not None:
                with_face = self.known[: self.n, i]
                with_face = with_face[~np.isnan(with_face)]
                self.face_state = self._told(with_face) if len(with_face) else self.face_state
        self.seen[self.n] = (self.images @ self.images[i] + 1) / 2
        if self.known is not None:
            self.known[self.n] = self.faces @ self.faces[i]
        self.n += 1

    @staticmethod
    def _told(s: np.ndarray) -> tuple[float, float]:
        return float(s.mean()), float(s.std()) if len(s) > 1 else 0.0

    def admits(self, at: np.ndarray, least: float, face_least: float, factor: float, need_face: bool) -> np.ndarray:
        """Which of the detections ``at`` fit: by faces where one meets a face of the match, else by images."""
        by_image = self._fits(self.seen[: self.n, at], least, *self.state, factor)
        if self.known is None:
            return by_image & ~np.full(len(at), need_face)
        faces = self.known[: self.n, at]
        met = ~np.isnan(faces).all(axis=0)
        fits = by_image & (not need_face)
        if met.any():
            fits[met] = self._fits(faces[:, met], face_least, *self.face_state, factor)
        return fits

    @staticmethod
    def _fits(s: np.ndarray, least: float, mean: float | None, spread: float | None, factor: float) -> np.ndarray:
        high = np.nanpercentile(s, 75, axis=0)
        return (high >= least) & ~((mean - high > factor * spread) if spread else np.zeros(s.shape[1], dtype=bool))


def match_entities(
    detections: DataFrame, threshold: float = 0.9, factor: float = 1.5, face_threshold: float = 0.4, require_face: bool = False, keep_single: bool = True
) -> DataFrame:
    """story, label, match, member, frame, pos and the state of the match from that member on.

    Within a story and label, the first free detection (by frame, then position) seeds a match, which takes the first
    admissible detection of a frame it has none of, again and again.  A detection is admitted if the 75th percentile of its
    similarities with the members reaches the threshold and lies no more than ``factor`` deviations under the match's mean;
    mean and deviation are those of the last admission's similarities, so the second member is held against neither.

    ``detections`` may have a column face (array, null where no face is seen).  A person is then judged by the products of its
    face with the faces of the match, under ``face_threshold`` and the state of the last admission by face, wherever there is
    any, else by images.  With ``require_face`` people without a face take no part and only faces count; without
    ``keep_single`` matches of one member go (numbers of matches then have gaps).  A group holds its vectors and a row of
    similarities for each member of the open match, of which a frame gives one.
    """
    columns = ["story", "label", "frame", "pos", "clip", *(["face"] if "face" in detections.columns else [])]

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        need_face = require_face and str(pdf["label"].iloc[0]).lower() == PERSON
        if need_face:
            pdf = pdf[pdf["face"].notna()] if "face" in pdf else pdf.iloc[:0]
        pdf = pdf.sort_values(["frame", "pos"], kind="stable").reset_index(drop=True)
        out: list[tuple] = []
        if len(pdf):
            images, faces, frames = _unit(pdf["clip"]), _faces(pdf), pdf["frame"].to_numpy()
            free, match, most = np.ones(len(pdf), dtype=bool), 0, len(np.unique(frames))
            while free.any():
                i, rows, held, open_ = int(free.argmax()), [], _OpenMatch(images, faces, most), free.copy()
                while i is not None:
                    held.add(i)
                    rows.append((match, len(rows), i, *held.state, *held.face_state))
                    free[i] = False
                    open_ &= free & (frames != frames[i])
                    at = np.flatnonzero(open_)
                    fits = held.admits(at, threshold, face_threshold, factor, need_face) if len(at) else at
                    i = int(at[fits.argmax()]) if fits.any() else None
                if keep_single or len(rows) > 1:
                    out += rows
                match += 1
        rows = pd.DataFrame(out, columns=["match", "member", "i", "similarity", "spread", "face_similarity", "face_spread"])
        picked = pdf.iloc[rows["i"].astype(int)].reset_index(drop=True)
        return pd.concat([picked[["story", "label"]], rows[["match", "member"]], picked[["frame", "pos"]], rows[["similarity", "spread", "face_similarity", "face_spread"]].astype(float)], axis=1)

    return detections.select(*columns).groupBy("story", "label").applyInPandas(group, MATCHED)


def entity_prefixes(matches: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Matches with running ids by kind: char for people, then obj for things, lm for landmarks, bg for the rest, by first sight.

    ``kinds`` (story, frame, pos, is_thing, is_landmark) tells what the first member is; without it labels that begin with
    ``thing`` are things.
    """
    firsts = matches.where("member = 0")
    if kinds is None:
        firsts = firsts.withColumns({"is_thing": F.startswith("label", F.lit("thing")), "is_landmark": F.lit(False)})
    else:
        firsts = firsts.join(kinds.select("story", "frame", "pos", "is_thing", "is_landmark"), ["story", "frame", "pos"], "left")
    kind = F.when(F.lower("label") == PERSON, "char").when(F.col("is_thing"), "obj").when(F.col("is_landmark"), "lm").otherwise("bg")
    n = F.row_number().over(Window.partitionBy("story", "prefix").orderBy("frame", "pos", "label"))
    return firsts.withColumn("prefix", kind).select("story", "label", "match", F.concat("prefix", n.cast("string")).alias("entity_id"))


def rank_matches(matches: DataFrame) -> DataFrame:
    """story, label, match, best, members, rank: by what the last admission by image, or by face, left, whichever is larger.

    A match of one member has 0; ties keep the order of first sight.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("member")))
    first = F.min_by(F.struct("frame", "pos", "label"), "member").alias("first")
    best = F.greatest(last("similarity"), F.coalesce(last("face_similarity"), F.lit(0.0)))
    each = matches.groupBy("story", "label", "match").agg(best.alias("best"), F.count("*").alias("members"), first)
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("story").orderBy(F.desc("best"), "first"))).drop("first")


def match_centroids(members: DataFrame, column: str = "clip") -> DataFrame:
    """story, label, match, members, with_face, centroid, faces: what is known of each match (members with ``clip``, maybe ``face``).

    The image centroid joins members one by one, the n-th (from 1) when n members are listed already, so it weighs 1 in n + 1
    and the first one 1 in 1: its weights are those of a mean that counts the first member twice.  Faces are a plain mean.
    Vectors are summed where they are read; only sums and first members meet.  All vectors of a kind have one length.
    """
    key = ["story", "label", "match"]
    vector = lambda c: array_to_vector(F.col(c).cast("array<double>"))
    total = lambda c: vector_to_array(Summarizer.sum(vector(c)))
    n = F.col("members")
    first = F.min_by(F.col(column).cast("array<double>"), "member")
    sums = members.groupBy(*key).agg(F.count("*").cast("int").alias("members"), total(column).alias("sum"), first.alias("first"))
    twice = F.zip_with("sum", "first", lambda s, f: (s + f) / (n + 1))
    out = sums.select(*key, "members", F.when(n > 1, twice).otherwise(F.col("first")).alias("centroid"))
    if "face" not in members.columns:
        return out.select(*key, "members", F.lit(0).alias("with_face"), "centroid", F.lit(None).cast("array<double>").alias("faces"))
    seen = members.where("face is not null").groupBy(*key).agg(F.count("*").cast("int").alias("with_face"), total("face").alias("faces"))
    out = out.join(seen, key, "left").withColumn("faces", F.transform("faces", lambda x: x / F.col("with_face")))
    return out.select(*key, "members", F.coalesce("with_face", F.lit(0)).alias("with_face"), "centroid", "faces")


def _inside(face: Column, person: Column) -> Column:
    cx, cy = (face["x1"] + face["x2"]) / 2, (face["y1"] + face["y2"]) / 2
    return cx.between(person["x"], person["x"] + person["w"]) & cy.between(person["y"], person["y"] + person["h"])


def _distance(face: Column, person: Column) -> Column:
    cx, cy = (face["x1"] + face["x2"]) / 2, (face["y1"] + face["y2"]) / 2
    diagonal = F.sqrt((face["x2"] - face["x1"]) ** 2 + (face["y2"] - face["y1"]) ** 2)
    return geometry.face_distance(cx, cy, person["x"] + person["w"] / 2, person["y"] + person["h"] / 2, diagonal, face["confidence"])


def assign_faces(people: DataFrame, faces: DataFrame, confidence: float = 0.7, least_side: float = 112.0) -> DataFrame:
    """frame, pos, face: people by rising area (then position) each take one free face whose centre is in their box.

    Faces (frame, face, confidence, x1, y1, x2, y2) count from the confidence on and if their longer side has the least
    length; boxes are in pixels.  A person with a mask (column mask, rows of 0 and 1 over its box, may be null or absent) looks
    at the first such face only and takes it if the mask has its centre; one without takes the nearest, the first of equals.
    People without a face are not in the result.  A group is the people and faces of one frame.
    """
    mask = F.col("mask").cast("array<array<int>>") if "mask" in people.columns else F.lit(None).cast("array<array<int>>")
    sure = faces.where((F.col("confidence") >= confidence) & (F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= least_side))
    seen = sure.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct(F.col("face").cast("bigint").alias("face"), "confidence", "x1", "y1", "x2", "y2"))).alias("faces"))
    person = F.struct((F.col("w") * F.col("h")).alias("area"), F.col("pos").cast("bigint").alias("pos"), "x", "y", "w", "h", mask.alias("mask"))
    held = people.groupBy("frame").agg(F.array_sort(F.collect_list(person)).alias("people")).join(seen, "frame")
    pair = "struct<pos:bigint,face:bigint>"

    def step(done: Column, p: Column) -> Column:
        free = F.filter("faces", lambda f: _inside(f, p) & ~F.exists(done, lambda d: d["face"] == f["face"]))
        first = F.try_element_at(free, F.lit(1))
        on_mask = F.when(face_in_mask(first, p, p["mask"]), first["face"])
        nearest = F.array_min(F.transform(free, lambda f: F.struct(_distance(f, p).alias("far"), f["face"].alias("face"))))["face"]
        face = F.when(F.size(free) > 0, F.when(p["mask"].isNotNull(), on_mask).otherwise(nearest))
        return F.when(face.isNull(), done).otherwise(F.array_append(done, F.struct(p["pos"].alias("pos"), face.alias("face")).cast(pair)))

    taken = F.aggregate("people", F.array().cast(f"array<{pair}>"), step)
    return held.select("frame", F.explode(taken).alias("z")).select("frame", "z.pos", "z.face")
