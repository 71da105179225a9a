"""Schemas of the inputs, given to the readers so that nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _struct(spec: str) -> T.StructType:
    """Fields `name type [not null]`, read here, as Spark's own reader needs a session."""
    fields = [f.split() for f in spec.split(",")]
    return T.StructType([T.StructField(f[0], _TYPES[f[1]], f[2:] != ["not", "null"]) for f in fields])


#: Facts with two grouping keys and six measures (fixed names).
SIX_FIELDS = _struct("id int not null, grp int not null, subgrp int not null, A int not null, B int not null, C double, D double, E double, F double")
#: People as one source gives them (fixed names); FieldA to FieldF are filled by one source each.
PEOPLE = _struct(
    "FirstName string, LastName string, StreetAddress string, City string, ZipCode string, SecretKey int, "
    "FieldA string, FieldB string, FieldC string, FieldD string, FieldE string, FieldF string"
)
#: Lines of a section file, whatever their kind (fixed names).
SPARSE_LINES = _struct(
    "Type string, StudentId int, StudentName string, Date string, WasAbroad boolean, Dept int, ClassCredits int, ClassGrade int, Major int, TriGPA double, TriCredits int"
)
#: What a student's section comes to.
STUDENT_SUMMARY = _struct("StudentId int, StudentName string, SourceLines int, GPA double, Major int, MajorGPA double")
