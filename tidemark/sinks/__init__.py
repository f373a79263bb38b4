"""Tables, files and streams that results go to."""
