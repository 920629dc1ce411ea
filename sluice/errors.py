"""Errors of the engine; all are user errors, so a command line ends with status 2."""


class FeedError(Exception):
    """Any error of this package."""


class ContractError(FeedError):
    """A contract, manifest or sample is wrong."""


class PlanError(FeedError):
    """A plan cannot be made or changed as asked."""


class RunNotFound(FeedError):
    """No such run, iteration or step."""


class InvalidTransition(FeedError):
    """The run's state doesn't allow that."""
