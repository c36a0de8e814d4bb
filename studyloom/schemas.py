"""Schemas of the working relations. Lists that carry identity have a position."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, I, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


VALUE = _struct(value_text=S, value_num=D, kind=S)
POINT = _struct(coordinates=T.ArrayType(D), space=S, values=T.ArrayType(VALUE))
ANALYSIS = _struct(name=S, description=S, table_id=S, parsed=B, points=T.ArrayType(POINT))
TABLE = _struct(table_id=S, table_label=S, table_caption=S, table_foot=S, table_data_path=S, table_raw_path=S, raw_table=S)

STUDY = _struct(
    pmid=S, pos=L, title=S, abstract=S, authors=T.ArrayType(S), journal=S, publication_date=S, doi=S, keywords=T.ArrayType(S),
    status=S, pmcid=L, abstract_screening_reason=S, abstract_screening_score=D, fulltext_screening_reason=S, fulltext_screening_score=D,
    abstract_inclusion_criteria_applied=T.ArrayType(S), abstract_exclusion_criteria_applied=T.ArrayType(S),
    fulltext_inclusion_criteria_applied=T.ArrayType(S), fulltext_exclusion_criteria_applied=T.ArrayType(S),
    metadata=T.MapType(S, S), retrieved_at=TS, screened_at=TS, full_text_path=S, full_text_source=S, fulltext_available=B,
    retrieval_in_scope=B, in_included_set=B, coordinate_space=S, activation_tables=T.ArrayType(TABLE), analyses=T.ArrayType(ANALYSIS),
)

SCREENING = _struct(
    study_id=S, decision=S, reason=S, confidence=D, model_used=S, screening_type=S, timestamp=S,
    inclusion_criteria_applied=T.ArrayType(S), exclusion_criteria_applied=T.ArrayType(S),
)
SCREENING_FILE = _struct(screening_results=T.ArrayType(SCREENING), timestamp=S)

DECISION = _struct(
    annotation_name=S, analysis_id=S, study_id=S, include=B, reasoning=S, confidence=D, model_used=S,
    inclusion_criteria_applied=T.ArrayType(S), exclusion_criteria_applied=T.ArrayType(S),
)

RESPONSE = _struct(task=S, study_id=S, item_id=S, attempt=I, payload=S)

COORDINATES_JSON = _struct(
    studyset=_struct(studies=T.ArrayType(_struct(analyses=T.ArrayType(_struct(
        name=S, metadata=_struct(table_id=S, table_label=S, raw_table_xml=S),
        points=T.ArrayType(_struct(coordinates=T.ArrayType(D), space=S)))))))
)

NIMADS_POINT = _struct(id=S, coordinates=T.ArrayType(D), space=S, kind=S, label_id=S, values=T.ArrayType(_struct(kind=S, value=S)), analysis_id=S)
NIMADS_ANALYSIS = _struct(id=S, name=S, description=S, weights=T.ArrayType(D), conditions=T.ArrayType(S), images=T.ArrayType(S), points=T.ArrayType(NIMADS_POINT), study_id=S)
NIMADS_STUDY = _struct(id=S, doi=S, name=S, metadata=T.MapType(S, S), description=S, publication=S, pmid=S, authors=S, year=I, analyses=T.ArrayType(NIMADS_ANALYSIS))
NIMADS_STUDYSET = _struct(id=S, name=S, description=S, publication=S, doi=S, pmid=S, studies=T.ArrayType(NIMADS_STUDY))
NIMADS_NOTE = _struct(note=T.MapType(S, B), analysis=S, annotation=S)
NIMADS_ANNOTATION = _struct(id=S, name=S, description=S, metadata=T.MapType(S, S), note_keys=T.MapType(S, S), studyset=S, notes=T.ArrayType(NIMADS_NOTE))
