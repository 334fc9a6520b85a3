"""Files of length-delimited messages as a batch and streaming source and a sink; containers of payloads."""

from .container import containers, read_container, write_containers
from .delimited import DelimitedSource, register

__all__ = ["DelimitedSource", "containers", "read_container", "register", "write_containers"]
