"""The command protocol: wire codec, dispatcher and column forms."""
