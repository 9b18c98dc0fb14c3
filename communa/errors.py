"""Exceptions of the public interface."""


class ClusterIndexingError(RuntimeError):
    """A node has no cluster in the partition asked."""


class EmptyNetworkError(ValueError):
    """A network without nodes can't be partitioned."""


class InvalidCommunityMappingError(ValueError):
    """A mapping of nodes to communities doesn't fit its network."""


class InternalNetworkIndexingError(RuntimeError):
    """A node id is not in the network."""


class ParameterRangeError(ValueError):
    """A parameter is outside its range."""


class UnsafeInducementError(RuntimeError):
    """A partition leaves nodes of the network out."""


class QueueError(RuntimeError):
    """A work queue was read while empty."""


class EdgeFileFormatError(ValueError):
    """A line of an edge file lacks a column or has no number where the weight should be."""


class EmptyEdgeFileError(ValueError):
    """An edge file has no edges."""


class ParseCliError(ValueError):
    """A command line can't be understood."""
