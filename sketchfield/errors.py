"""What can go wrong, by kind."""

from __future__ import annotations


class SketchError(Exception):
    """Base of all errors of this library."""


class InvalidParameters(SketchError, ValueError): ...


class FalsePositiveRateOutOfBounds(InvalidParameters): ...


class InvalidItemCount(InvalidParameters): ...


class InvalidHashCount(InvalidParameters): ...


class InvalidFilterSize(InvalidParameters): ...


class InvalidRange(InvalidParameters): ...


class IndexOutOfBounds(SketchError, IndexError): ...


class CapacityExceeded(SketchError): ...


class MaxFiltersExceeded(SketchError): ...


class UnsupportedOperation(SketchError): ...


class IncompatibleFilters(SketchError): ...


class SerializationError(SketchError): ...


class InternalError(SketchError): ...


class CounterOverflow(SketchError): ...


class CounterUnderflow(SketchError): ...
