"""Where lines come from."""


def register(spark) -> None:
    """Make the streaming sources known to a session. Their code is sent along, since the processes that read streams don't see what
    was shipped to the executors."""
    from pyspark import cloudpickle

    from .. import errors
    from . import network, tail

    for module in (errors, network, tail):
        cloudpickle.register_pickle_by_value(module)
    for source in (network.TcpLines, network.UdpLines, tail.TailLines):
        spark.dataSource.register(source)
