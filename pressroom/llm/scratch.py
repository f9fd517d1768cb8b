"""Tables that cut lineage, in the folder that all machines share."""

from ..storage import keep as keep
from ..storage import new_folder as new_folder
