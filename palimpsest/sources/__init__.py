"""Sources: folders of old files with their forks, sidecars and disk images."""
