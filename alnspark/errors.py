"""Errors of the engine.  On executors they surface as Spark errors that carry the same name."""


class AlignmentError(ValueError):
    """Base of all errors here."""


def _error(name: str, doc: str) -> type[AlignmentError]:
    return type(name, (AlignmentError,), {"__doc__": doc, "__module__": __name__})


AmbiguousInputFormatErr = _error("AmbiguousInputFormatErr", "The first line fits more than one format.")
UnrecognizedInputFormatErr = _error("UnrecognizedInputFormatErr", "The first line fits no format.")
CorruptedInputErr = _error("CorruptedInputErr", "A line or container does not follow its format.")
NeedTargetSequences = _error("NeedTargetSequences", "No target list was given and the input has no header.")
NeedQueryNamesErr = _error("NeedQueryNamesErr", "Queries have to be looked up, but no query list was given.")
HeaderNotConsumedError = _error("HeaderNotConsumedError", "A header line was parsed as a record.")
DuplicatedQueriesErr = _error("DuplicatedQueriesErr", "A query occurs more than once.")
IncompatibleFileHeadersErr = _error("IncompatibleFileHeadersErr", "Inputs differ in targets or in the fields they hold.")
QueryIdsNotFilled = _error("QueryIdsNotFilled", "An input lacks query ids.")
QueryNamesNotFilled = _error("QueryNamesNotFilled", "An input lacks query names.")
KeyNotFound = _error("KeyNotFound", "A name is not in its dictionary.")
IndexNotFound = _error("IndexNotFound", "An index is not in its dictionary.")
HeaderPromiseNotHonoured = _error("HeaderPromiseNotHonoured", "A block lacks what the file header announces.")
InvalidConversion = _error("InvalidConversion", "A number does not fit where it has to go.")
SetBitsNotSorted = _error("SetBitsNotSorted", "Set bits are not in ascending order.")
ContainerHeaderError = _error("ContainerHeaderError", "The file does not begin like a container.")
ContainerVersionError = _error("ContainerVersionError", "The container's version is not known.")
FieldMissing = _error("FieldMissing", "A record lacks a field that the output format shows.")
EncodeError = _error("EncodeError", "Records cannot be put into a container.")
