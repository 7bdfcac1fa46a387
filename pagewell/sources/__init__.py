"""Table, file and stream readers and the sinks that write them."""
