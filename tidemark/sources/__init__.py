"""Sources: tables, epochs given as values, folders that are streamed, and pollers."""

from .epochs import from_epochs, from_parquet, named_inputs
from .polling import PollingSource
from .stream import AsyncSender, EpochFolder, FrameFolder, stream_from_dir

__all__ = ["AsyncSender", "EpochFolder", "FrameFolder", "PollingSource", "from_epochs", "from_parquet", "named_inputs", "stream_from_dir"]
